"""SentencePiece encoding and decoding over a relational lattice of distinct word parts."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import store, table

SPACE = "▁"
#: Text bytes (about) whose distinct atoms are looked up together.
BLOCK_BYTES = 8 << 20
#: Input bytes (about) for each bucket of atoms.
BUCKET_BYTES = 4 << 20
#: Atoms of so many characters or more are folded in Python, to the same ids: the native fold is quadratic in them.
NATIVE_CHARS = 48
#: Longest piece, in characters, that an edge has bits for; models with longer ones are folded in Python.
NATIVE_PIECE = 16
#: A larger vocabulary is refused, as its pieces are broadcast.
MOST_PIECES = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
#: A character without a piece costs so much more than the worst piece, in unigram models.
UNKNOWN_PENALTY = 10.0
#: The rank of an edge that is a character without a piece.
NO_PIECE = (1 << 17) - 1
#: Bits of an edge, from the lowest: right spine, left spine, place of the last merge (0 if none), rank, 16 less the length, end.
#: So sorted edges are in order of where they end, the longest first: most often it is the one sought.
_LEFT, _SPLIT, _RANK, _LENGTH, _END = 15, 30, 36, 53, 57


def _spelled(text: str, rank: int) -> int:
    """Rank and length as bits; pieces too long for them have none, as their models are folded in Python."""
    return rank << _RANK | max(0, NATIVE_PIECE - len(text)) << _LENGTH


@dataclass
class Model:
    """What encoding needs of a SentencePiece model."""

    kind: int
    pieces: list[tuple[str, float, int]]  # text, score, type; the place is the id
    unknown: int = 0
    bytes_at: list[int] = field(default_factory=list)  # ids of <0x00> .. <0xFF>, or none

    def __post_init__(self) -> None:
        if len(self.pieces) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        normal = self.normal()
        if any(SPACE in text.lstrip(SPACE) for text, _, _ in normal):
            raise ValueError("pieces across words aren't supported")
        self.bridges = frozenset(text[i : i + 2] for text, _, _ in normal for i in range(len(text) - 1))
        self.order = [i for _, _, i in sorted(normal, key=lambda x: -x[1])]  # ids, best score first
        self.longest = max((len(text) for text, _, _ in normal), default=1)
        self.worst = min((score for _, score, _ in normal), default=0.0)
        #: Spelling (with plain spaces) to rank.
        self.ranks = {self.pieces[i][0].replace(SPACE, " "): rank for rank, i in enumerate(self.order)}
        self.codes, ordered = self._codes()
        self.native = ordered and self.longest <= NATIVE_PIECE and len(self.order) < NO_PIECE

    def normal(self) -> list[tuple[str, float, int]]:
        return [(text, score, i) for i, (text, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]

    def _codes(self) -> tuple[dict[str, int], bool]:
        """Spelling to its edge but for the end, its last merge counted from its start, and whether every merge ranks behind the merges that make its parts.

        Under BPE, a piece that its own characters don't merge to can't occur in
        any text and has no edge. ``split`` is where the last merge of a piece
        joins its parts; the spines are the lengths of all the parts at its left
        and right end, over all its merges.
        """
        if self.kind != BPE:
            return {text: _spelled(text, rank) for text, rank in self.ranks.items()}, True
        spines: dict[str, tuple[int, int, int]] = {}
        ordered = True
        for text in sorted(self.ranks, key=len):
            parts, split = list(text), 0
            while len(parts) > 1:
                ways = [(self.ranks.get(a + b, NO_PIECE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(ways)
                if rank == NO_PIECE:
                    break
                split = len(parts[0])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) > 1:
                continue
            left = right = 0
            if split:
                a, b = text[:split], text[split:]
                left = 1 << (len(a) - 1) | spines.get(a, (0, 0, 0))[1]
                right = 1 << (len(b) - 1) | spines.get(b, (0, 0, 0))[2]
                ordered &= all(len(x) == 1 or self.ranks[x] < self.ranks[text] for x in (a, b))
            spines[text] = (split, left, right)
        return {text: _spelled(text, self.ranks[text]) | split << _SPLIT | left << _LEFT | right for text, (split, left, right) in spines.items()}, ordered

    @property
    def edges(self) -> list[tuple[str, int, bool]]:
        """Spelling, its edge as at the start of a word, and whether it has a merge."""
        return [(text, len(text) << _END | code, bool(code >> _SPLIT & 63)) for text, code in self.codes.items()]

    @classmethod
    def read(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, {x.type for x in proto.pieces}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that take text as it is, with a dummy prefix, are supported")
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or kinds & {USER, UNUSED}:
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        pieces = [(x.piece, x.score, x.type) for x in proto.pieces]
        spelled = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        bytes_at = [spelled[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else []
        return cls(proto.trainer_spec.model_type, pieces, next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN), bytes_at)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode("utf-8", "replace")] if self.bytes_at else [self.unknown]


class Cutter:
    """Cuts texts into atoms, and deals a block's distinct atoms into buckets.

    An atom is a run of characters in which each two neighbours stand side by
    side in some piece: no piece, so no path of the lattice, crosses its ends.
    Texts are led by a space; marks of spaces are written as spaces.
    """

    #: Places of the table of neighbours. Two pairs that share a place only make atoms longer.
    PLACES = 1 << 24

    def __init__(self, bridges: frozenset[str], buckets: int) -> None:
        bridges = {b.replace(SPACE, " ") for b in bridges}
        chars = sorted({c for pair in bridges for c in pair})
        self.kinds = np.zeros(0x110000, np.uint32)
        self.kinds[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width, self.buckets = len(chars) + 1, buckets
        self.joined = np.zeros(min(self.width**2, self.PLACES), bool)
        for a, b in bridges:
            self.joined[(int(self.kinds[ord(a)]) * self.width + int(self.kinds[ord(b)])) % len(self.joined)] = True

    def cut(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """The atoms of all texts in order, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        texts = pc.binary_join_element_wise(lead, texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].tobytes()
        offsets = offsets - offsets[0]
        kinds = self.kinds[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).astype(np.int32)
        cuts = np.ones(len(at), bool)
        if len(at):
            cuts[1:] = ~self.joined[(kinds[:-1] * np.uint32(self.width) + kinds[1:]) % np.uint32(len(self.joined))]
            cuts[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(raw)])] = True
            if b"\0" in raw:  # which parts atoms in lists, so it must be one of its own
                zero = np.frombuffer(raw, np.uint8)[at] == 0
                cuts |= zero
                cuts[1:] |= zero[:-1]
        starts = at[cuts]
        atoms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(raw))).astype(np.int32)), pa.py_buffer(raw))
        return atoms, np.diff(np.searchsorted(starts, offsets))

    def code(self, texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct atoms in order of bucket, their buckets, the atoms of all texts by their places, and each array's counts.

        Long atoms have buckets of their own, from ``buckets`` on. The character
        of code 0 has bucket -1.
        """
        cut = [self.cut(x) for x in texts]
        coded = pa.chunked_array([a for a, _ in cut], pa.string()).combine_chunks().dictionary_encode()
        words = coded.dictionary
        bucket = self._bucket(words)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return words.take(pa.array(order)), bucket[order], place[np.asarray(coded.indices)], [n for _, n in cut]

    def _bucket(self, words: pa.StringArray) -> np.ndarray:
        bucket = np.concatenate([self._hash(words.slice(at, 1 << 14)) for at in range(0, len(words), 1 << 14)] or [np.zeros(0, np.int64)])
        bucket += self.buckets * (np.asarray(pc.utf8_length(words)) >= NATIVE_CHARS)
        bucket[np.asarray(pc.equal(words, "\0"))] = -1
        return bucket

    def _hash(self, words: pa.StringArray) -> np.ndarray:
        """Differences of running sums of bytes times powers of an odd number, brought back to the word's start."""
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        offsets -= offsets[0]
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            power = np.cumprod(np.append(np.uint64(1), np.full(len(raw), base, np.uint64)), dtype=np.uint64)
            back = np.cumprod(np.append(np.uint64(1), np.full(len(raw), pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)
            total = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * power[:-1], dtype=np.uint64))
            mixed = (total[offsets[1:]] - total[offsets[:-1]]) * back[offsets[:-1]] * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """A task's rows cut into blocks; the same file split gives the same blocks each time."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield task << 24 | number, held
                number, held, size = number + 1, [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield task << 24 | number, held
        pa.default_memory_pool().release_unused()


def _lists(words: pa.Array, bucket: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The buckets, and the atoms of each, joined by the character of code 0 (which is no part of an atom but its own)."""
    names, first = np.unique(bucket, return_index=True)
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words), "\0")
    return names[names >= 0], joined.filter(pa.array(names >= 0))


def block_words(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, list): the distinct atoms of each block, dealt into buckets by their hash; ``list`` is the block's number and its atoms."""
    bridges = model.bridges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(bridges, buckets)
        for block, parts in _blocks(batches):
            words, bucket, _, _ = cutter.code([x.column(1) for x in parts])
            names, joined = _lists(words, bucket)
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pc.binary_join_element_wise(str(block), joined, "\0")], names=["bucket", "list"])

    return docs.mapInArrow(run, "bucket int, list string")


def lattice(words: DataFrame, pieces: DataFrame, longest: int, by: list[str]) -> DataFrame:
    """words (``by``, word: an atom) with edges: all pieces that a word's substrings equal, and its characters without a piece.

    Substrings of bounded length are exploded, joined to the piece table and
    grouped by word. ``pieces``: piece, code (its edge at the start of a word),
    merged. An edge is one number: where it ends, rank (0 for the best score;
    NO_PIECE for a character without a piece), length, and how the piece is made by merges.
    """
    marked = words.withColumn("size", F.char_length("word")).withColumn("mark", F.xxhash64("word"))
    starts = marked.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    spans = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("start")))))
    spans = spans.select(*by, "mark", "word", "start", "n", F.col("word").substr(F.col("start") + 1, F.col("n")).alias("piece"))
    met = spans.join(F.broadcast(pieces), "piece", "left").where("code IS NOT NULL OR n = 1")
    moved = F.shiftleft(F.col("start").cast("bigint"), _END) + F.when(F.col("merged"), F.shiftleft(F.col("start").cast("bigint"), _SPLIT)).otherwise(0)
    edge = F.coalesce("code", F.lit(1 << _END | (NATIVE_PIECE - 1) << _LENGTH | NO_PIECE << _RANK)) + moved
    # Grouping by the hash first lets the sort compare numbers, not words.
    return met.select("mark", "word", *by, edge.alias("edge")).groupBy("mark", "word", *by).agg(F.collect_list("edge").alias("edges"))


def _bits(edge: Column, at: int, n: int) -> Column:
    return F.shiftright(edge, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def _rank(edge: Column) -> Column:
    return _bits(edge, _RANK, 17)


def _end(edge: Column) -> Column:
    return F.shiftright(edge, _END).cast("int")


def _start(edge: Column) -> Column:
    return _end(edge) + _bits(edge, _LENGTH, 4) - NATIVE_PIECE


def _with(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _path(best: Column, size: Column) -> Column:
    """The edges chosen, in order: ``best`` has at each position the ``edge`` that ends there."""

    def back(s: Column, _: Column) -> Column:
        edge = F.get(best, s["at"])["edge"]
        return F.when(s["at"] <= 0, s).otherwise(_with(edge, lambda e: F.struct(_start(e).alias("at"), F.array_append(s["path"], e).alias("path"))))

    start = F.struct(size.alias("at"), F.array().cast("array<bigint>").alias("path"))
    return F.aggregate(F.sequence(F.lit(1), size), start, back, lambda s: F.reverse(s["path"]))


def _best_scores(edges: Column, size: Column, scores: Column, unknown: float) -> Column:
    """Viterbi: a fold over positions that keeps the best (score, start, edge) up to each."""

    def step(best: Column, at: Column) -> Column:
        ending = F.filter(edges, lambda e: _end(e) == at)
        score = lambda e: F.when(_rank(e) == NO_PIECE, F.lit(unknown)).otherwise(F.get(scores, _rank(e)))
        ways = F.transform(ending, lambda e: F.struct((F.get(best, _start(e))["score"] + score(e)).alias("score"), _start(e).alias("start"), e.alias("edge")))
        return F.array_append(best, F.array_max(ways))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(-1).cast("bigint").alias("edge")))
    return _with(F.aggregate(F.sequence(F.lit(1), size), first, step), lambda best: _path(best, size))


def _best_merges(edges: Column, size: Column) -> Column:
    """Viterbi over merges: a fold that keeps for each position the one edge that merging the text up to there would end with.

    Merging a text gives the one path whose neighbours each stay as they are when
    the two are merged alone. So the edge at a position is the one that its
    start's edge suffers as a neighbour. Two neighbours don't stay if some piece
    whose last merge joins a part at the right end of the first to a part at the
    left end of the second ranks before the merges that would use up either part;
    with equal ranks the merge further left comes first.

    The fold walks the edges in order of their ends. ``done`` has the edge at each
    position but the newest, ``n``, whose edge is ``last``; ``crossing`` has
    the pieces that an edge leaves possible across its end.
    """
    one = F.lit(1)
    held = "struct<edge:bigint,crossing:array<bigint>>"
    none = F.array().cast("array<bigint>")
    shifted = lambda x, n: F.call_function("shiftright", x, n)
    joint = F.lit(63 << _SPLIT)

    def rank_of(end: Column, n: Column) -> Column:
        """The rank of the edge of length n that ends there; the key is computed once, not for each edge."""
        key = F.shiftleft(end.cast("bigint"), _END).bitwiseOR(F.shiftleft((F.lit(NATIVE_PIECE) - n).cast("bigint"), _LENGTH))
        own = F.lit(63 << _END | 15 << _LENGTH)
        return _with(key, lambda key: _rank(F.get(F.filter(edges, lambda y: y.bitwiseAND(own) == key), F.lit(0))))

    def used_up(spine: Column, k: Column, whole: Column, of) -> Column:
        """The rank that uses up the part of length k: the next longer part's, or the whole edge's."""
        more = lambda above: k + one + F.bit_count(above.bitwiseAND(-above) - one).cast("int")
        return _with(shifted(spine, k), lambda above: F.when(above == 0, _rank(whole)).otherwise(of(more(above))))

    def lasts_left(c: Column, x: Column) -> Column:
        """Whether the part of x at its left end that reaches to c's end is there when c is merged."""
        k, spine = _end(c) - _start(x), _bits(x, _LEFT, 15)
        part = shifted(spine, k - one).bitwiseAND(one) == 1
        return (_end(c) == _end(x)) | (part & (_rank(c) <= used_up(spine, k, x, lambda n: rank_of(_start(x) + n, n))))

    def lasts_right(c: Column, x: Column) -> Column:
        """Whether the part of x at its right end that begins where c does is there when c is merged; a part longer than x has no bit."""
        k, spine = _end(x) - _start(c), _bits(x, 0, 15)
        part = shifted(spine, k - one).bitwiseAND(one) == 1
        return (_start(c) == _start(x)) | (part & (_rank(c) < used_up(spine, k, x, lambda n: rank_of(_end(x), n))))

    def folded(merged: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            at = F.shiftright(x, _END)
            before = lambda s: F.when(s == state["n"], state["last"]["crossing"]).otherwise(F.get(state["done"], s)["crossing"])
            stays = ~F.exists(before(_start(x)), lambda c: (F.shiftright(c, _END) <= at) & lasts_left(c, x))
            possible = lambda p: F.filter(merged, lambda c: (c.bitwiseAND(joint) == p) & lasts_right(c, x))
            last = F.struct(x.alias("edge"), _with(F.shiftleft(at, _SPLIT), possible).alias("crossing"))
            onward = F.struct((state["n"] + one).alias("n"), F.array_append(state["done"], state["last"]).alias("done"), last.alias("last"))
            return F.when((at > state["n"]) & stays, onward).otherwise(state)

        nothing = F.struct(F.lit(-1).cast("bigint").alias("edge"), none.alias("crossing"))
        first = F.struct(F.lit(0).alias("n"), F.array().cast(f"array<{held}>").alias("done"), nothing.alias("last"))
        return _with(F.aggregate(F.sort_array(edges), first, step, lambda s: F.array_append(s["done"], s["last"])), lambda best: _path(best, size))

    return _with(F.filter(edges, lambda e: e.bitwiseAND(joint) != 0), folded)


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fold(model: Model, word: Column) -> Column:
    """The ids of a word from its ``edges``: the best path, by Viterbi, in the order of the text."""
    edges, size = F.col("edges"), F.char_length(word)
    if model.kind == BPE:
        chosen = _best_merges(edges, size)
    else:
        chosen = _best_scores(edges, size, _literal([model.pieces[i][1] for i in model.order], "double"), model.worst - UNKNOWN_PENALTY)
    ids = _literal(model.order, "int")
    byte_ids = _literal(model.bytes_at or [0], "int")

    def spelled(e: Column) -> Column:
        if not model.bytes_at:
            return F.array(F.lit(model.unknown))
        code = F.hex(F.encode(word.substr(_start(e) + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.get(byte_ids, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))

    bare = lambda e: _rank(e) == NO_PIECE
    mixed = lambda c: F.flatten(F.transform(c, lambda e: F.when(bare(e), spelled(e)).otherwise(F.array(F.get(ids, _rank(e))))))
    return _with(chosen, lambda c: F.when(F.exists(c, bare), mixed(c)).otherwise(F.transform(c, lambda e: F.get(ids, _rank(e)))))


def fold_text(model: Model, text: str) -> list[int]:
    """The ids of an atom of any length in plain Python, in time near linear in it: the same as ``fold``.

    BPE: the best-ranked adjacent pair that is a piece is merged, the leftmost of
    equals, until none is left. Unigram: the best path; of equal scores the one
    whose last piece is shortest.
    """
    ranks, n = model.ranks, len(text)
    if model.kind == BPE:
        after = np.arange(1, n + 2, dtype=np.int32)  # the end of the piece that starts here
        before = np.arange(-1, n, dtype=np.int32)  # the start of the piece before the one that starts here
        alive = np.ones(n + 1, bool)
        heap = [rank << 32 | s for s in range(n - 1) if (rank := ranks.get(text[s : s + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, s = top >> 32, top & 0xFFFFFFFF
            if not alive[s] or (m := int(after[s])) >= n:
                continue
            e = int(after[m])
            if ranks.get(text[s:e]) != rank:
                continue
            alive[m] = False
            after[s] = e
            if e < n:
                before[e] = s
                if (r := ranks.get(text[s : after[e]])) is not None:
                    heapq.heappush(heap, r << 32 | s)
            if s and (r := ranks.get(text[(b := int(before[s])) : e])) is not None:
                heapq.heappush(heap, r << 32 | b)
        cuts = np.flatnonzero(alive).tolist()
    else:
        best = np.zeros(n + 1)
        come = np.zeros(n + 1, np.int32)
        for e in range(1, n + 1):
            ways = [(best[s] + model.pieces[model.order[rank]][1], s) for s in range(max(0, e - model.longest), e) if (rank := ranks.get(text[s:e])) is not None]
            if text[e - 1] not in ranks:
                ways.append((best[e - 1] + model.worst - UNKNOWN_PENALTY, e - 1))
            best[e], come[e] = max(ways)
        cuts = [n]
        while cuts[-1] > 0:
            cuts.append(int(come[cuts[-1]]))
        cuts.reverse()
    out: list[int] = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        rank = ranks.get(text[s:e])
        out += model.fallback(text[s:e]) if rank is None else [model.order[rank]]
    return out


def word_ids(model: Model, words: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, word, ids) of distinct atoms of under NATIVE_CHARS characters, by lattice and native fold."""
    pieces = words.sparkSession.createDataFrame(model.edges, "piece string, code bigint, merged boolean")
    return lattice(words, pieces, model.longest, by).select(*by, "word", fold(model, F.col("word")).alias("ids"))


def long_ids(model: Model, words: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, word, ids) of distinct atoms of any length, folded in Python one by one."""
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [fold_text(model, w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in by), batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=[*by, "word", "ids"])

    return words.select(*by, "word").mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in by) + ", word string, ids array<int>")


def _ints(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of an array of lists of numbers."""
    return np.asarray(pc.list_value_length(lists)).astype("<i4"), np.asarray(lists.flatten()).astype("<i4")


#: Atoms of a block, the most frequent, that a packed text names by one byte.
_COMMON = 255


def _packed(docs: pa.Table, counts: np.ndarray, codes: np.ndarray, words: pa.Array, bucket: np.ndarray) -> bytes:
    """A block's documents with their texts as places of atoms: one byte for a common atom, or a mark and four bytes in planes."""
    names, joined = _lists(words, bucket)
    marks = [zlib.crc32(x.as_py().encode()) for x in joined]
    if len(bucket) and bucket[0] < 0:
        names, marks = np.append(-1, names), [0, *marks]
    often = np.bincount(codes, minlength=len(words))
    common = np.argsort(-often, kind="stable")[:_COMMON].astype("<i4")
    byte = np.full(len(words), _COMMON, np.uint8)
    byte[common] = np.arange(len(common), dtype=np.uint8)
    byte = byte[codes]
    rest = codes[byte == _COMMON].astype("<i4").view(np.uint8).reshape(-1, 4).T
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    head = np.array([len(counts), len(codes), rest.shape[1], len(common), len(names)], "<i8")
    arrays = (head, counts.astype("<i4"), common, names.astype("<i4"), np.array(marks, "<i8"), byte, rest)
    return zstandard.compress(b"".join([x.tobytes() for x in arrays] + [sink.getvalue().to_pybytes()]), 3)


def _unpacked(body: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, counts, codes, buckets, marks) of what ``_packed`` made."""
    raw, at = zstandard.decompress(body), 0

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, n, at)
        at += found.nbytes
        return found

    docs, atoms, others, common, lists = read("<i8", 5).tolist()
    counts, common = read("<i4", docs), read("<i4", common)
    names, marks = read("<i4", lists), read("<i8", lists)
    byte, rest = read("u1", atoms), read("u1", 4 * others).reshape(4, -1)
    place = np.zeros(_COMMON + 1, np.int32)
    place[: len(common)] = common
    codes = place[byte]
    codes[byte == _COMMON] = np.ascontiguousarray(rest.T).view("<i4").ravel()
    return pa.ipc.open_stream(pa.py_buffer(raw).slice(at)).read_all(), counts, codes, names, marks


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, ids (array of int), as the SentencePiece library gives them without begin and end marks.

    docs: doc_id, text (more columns, whatever their names, are ignored), read
    from files, whose splits give the same rows in the same order when a task
    runs again; a document set that is computed should be stored first. A null
    or empty text has no ids; bytes that aren't UTF-8 count as U+FFFD. Repeated
    rows, and rows with one or no doc_id, each return. An empty table gives an
    empty result. Words and texts may have any length under 2 GB.

    1. Blocks of documents list their distinct atoms (word parts that no piece
       reaches across), packed by hash bucket. Buckets are as many as the input's
       size asks for.
    2. Per bucket, the distinct atoms' substrings are joined to the pieces,
       grouped by atom, and folded with ``aggregate``: a Viterbi over scores
       under a unigram model, over merges under a BPE model (``_best_merges``).
       Atoms of NATIVE_CHARS characters or more, and all under models that an
       edge has no bits for, are folded in Python to the same ids.
    3. Each block gets the ids of its atoms back, in the order of its lists, and
       its documents are put together. A list that differs from the first pass
       (an unstable input) is an error, never a wrong id.

    What is shuffled are texts once, as packed places of atoms, and each block's atom lists. No key
    is a word or a document, so no frequent word or source fills a task. A task
    holds one block, or one bucket of all blocks, as Arrow arrays.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.make_valid_utf8("text").alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(tasks, size // BUCKET_BYTES), 1 << 20)
    bridges, zero = model.bridges, np.array(model.fallback("\0"), "<i4")
    # One exchange serves the atoms and the answers. A stated number of tasks isn't coalesced: little is read, but much made of it.
    listed = store(block_words(docs, model, buckets), "words").repartition(tasks, "bucket")
    atoms = F.split("list", "\0")
    words = listed.select("bucket", F.explode(F.slice(atoms, F.lit(2), F.size(atoms) - 1)).alias("word")).distinct()
    if model.native:
        short = F.char_length("word") < NATIVE_CHARS
        known = word_ids(model, words.where(short), ["bucket"]).unionByName(long_ids(model, words.where(~short), ["bucket"]))
    else:
        known = long_ids(model, words, ["bucket"])

    def answer(lists: pa.Table, found: pa.Table) -> pa.Table:
        blocks, packed = [], []
        names, own = found.column("word").combine_chunks(), found.column("ids").combine_chunks()
        for text in lists.column("list").to_pylist():
            block, _, text = text.partition("\0")
            at = pc.index_in(pa.array(text.split("\0"), pa.string()), value_set=names)
            if at.null_count:
                raise RuntimeError("an atom has no ids")
            sizes, values = _ints(own.take(at))
            head = np.array([len(sizes), len(values), zlib.crc32(text.encode())], "<i8")
            blocks.append(int(block))
            packed.append(zstandard.compress(head.tobytes() + sizes.tobytes() + values.tobytes(), 1))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": lists.column("bucket"), "packed": pa.array(packed, pa.binary())})

    answers = listed.groupBy("bucket").cogroup(known.withColumnRenamed("bucket", "own_bucket").groupBy("own_bucket")).applyInArrow(answer, "block bigint, bucket int, packed binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(bridges, buckets)
        for block, parts in _blocks(batches):
            words, bucket, codes, counts = cutter.code([x.column(1) for x in parts])
            body = _packed(pa.Table.from_batches([x.select([0]) for x in parts]), np.concatenate(counts), codes, words, bucket)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([body], pa.binary())], names=["block", "body"])

    texts = docs.mapInArrow(pack, "block bigint, body binary")

    def assemble(rows: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, counts, codes, names, marks = _unpacked(rows.column("body")[0].as_py())
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist(), strict=True))
        sizes, values = [], []
        for name, mark in zip(names.tolist(), marks.tolist(), strict=True):
            if name < 0:
                sizes.append(np.array([len(zero)], "<i4"))
                values.append(zero)
                continue
            body = zstandard.decompress(given.pop(name, None) or b"")
            n, m, own = np.frombuffer(body, "<i8", 3).tolist()
            if own != mark:
                raise RuntimeError("the documents of a block changed between two passes; store them first")
            sizes.append(np.frombuffer(body, "<i4", n, 24))
            values.append(np.frombuffer(body, "<i4", m, 24 + 4 * n))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, "<i4")]))]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, "<i4")]).astype(np.int32)))
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for at in range(0, docs.num_rows, 256):
            own = ends[at : at + 257]
            found = ids.take(pa.array(codes[own[0] : own[-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(found.offsets)[own - own[0]].astype(np.int32)), found.values)
            out.append(pa.RecordBatch.from_arrays([docs.column(0).slice(at, 256).combine_chunks(), lists], names=["doc_id", "ids"]))
        return pa.Table.from_batches(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("block").cogroup(answers.withColumnRenamed("block", "own_block").groupBy("own_block")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def decode(model: Model, ids: str | Column = "ids") -> Column:
    """The text of ids, as the library gives it: pieces joined, byte pieces as bytes, the leading space dropped; control pieces are empty."""

    def code(text: str, kind: int) -> str:
        if kind == BYTE:
            return text[3:5]
        return "" if kind == CONTROL else (" ⁇ " if kind == UNKNOWN else text.replace(SPACE, " ")).encode().hex()

    codes = F.split(F.lit(",".join(code(text, kind) for text, _, kind in model.pieces)), ",")
    ids = F.col(ids) if isinstance(ids, str) else ids
    raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(codes, i)), "")).cast("string")
    text = F.make_valid_utf8(raw)
    return F.when(text.startswith(" "), text.substr(F.lit(2), F.char_length(text))).otherwise(text)


def default_model() -> Model:
    import public_tokenizers

    return Model.read(public_tokenizers.path("piece_bpe_32k.model"))


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids, decoded."""
    return encode(docs, model).withColumn("decoded", decode(model))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of pieces, a hash of the ids, bytes and a hash of the text decoded from them."""
    rows = encoded(table(spark, sf_dir, "documents"), default_model())
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.octet_length("decoded").cast("bigint").alias("decoded_bytes"), F.md5("decoded").alias("decoded_md5"))
