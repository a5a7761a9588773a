"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece of the model can reach across: between two characters
that stand beside each other in no piece.  Every distinct unit is encoded once: its
substrings up to the longest piece are exploded and equi-joined to the piece table;
the hits are the edges of the unit's lattice, grouped by unit and folded by Spark's
``aggregate``.  The fold is Viterbi for unigram models.  For BPE models the
best-scoring path is not what the library's encoder returns, so there the fold over
the same edges is the encoder's own rule, the best-ranked merge of two neighbours
first; the state is a bit mask of boundaries.

Texts travel as blocks: a task turns the texts it reads into numbers of distinct
units, and each block later looks up the ids of its distinct units.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, trim

SPACE = "▁"
#: Stands between units that are listed together; as a unit of its own it is left out of the lattice.
SEPARATOR = "\n"
#: Longest unit whose boundaries fit the fold's mask; longer units take the same rule in plain code.
LONGEST = 60
#: Characters of text that a block holds about; a longer text is a block of its own.
BLOCK = 11 << 20
#: Characters that are cut at a time: bounds what a task holds besides its block.
CHUNK = 1 << 18
#: Partitions of units for each of blocks: a unit has some ten edges, so that grouping them needs small partitions to stay in memory.
SPREAD = 4
#: Units or documents whose ids are put together at a time.
PART, LISTS = 1 << 18, 256
#: Bytes of a row of a block about: long rows cost a JVM several times their length.
SHORT = 1 << 18
CHANGED = "a block changed while it was being encoded: the documents must be the same rows whenever they are read"
#: A unit's place is its block, the block being a task's number and a number within the task, and its number in the block.
UNIT_BITS, SEQ_BITS = 28, 13
#: The hash comes first: sorting then seldom compares more than its bits.
KEYS = ["hash", "unit", "slot"]
#: Fixed value: how much worse than the worst piece the library's unigram encoder rates an unknown character.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """What a model file says: texts and scores of normal pieces, byte ids, and which kind of model it is."""

    ids: dict[str, int]
    scores: dict[str, float]
    first_byte: int | None
    unknown: int
    unigram: bool
    texts: tuple[bytes | None, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of every code point (0: in no piece of several characters), and whether two classes stand beside each other in a piece."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        alphabet = sorted({c for pair in pairs for c in pair})
        kinds = np.zeros(0x110000, np.int32)
        kinds[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        beside = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for a, b in pairs:
            beside[kinds[ord(a)], kinds[ord(b)]] = True
        return kinds, beside


def load(path: str) -> Pieces:
    """Read a model file; only identity normalisation with a leading space and escaped spaces is supported."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or model.trainer_spec.model_type not in (1, 2):
        raise ValueError("this model normalises texts or segments in a way that is not supported")
    kind = {i: p.type for i, p in enumerate(model.pieces)}
    if any(SEPARATOR in p.piece and len(p.piece) > 1 for p in model.pieces) or any(k in (4, 5) for k in kind.values()):
        raise ValueError("user-defined and unused pieces, and longer ones with a line end, are not supported")
    normal = {p.piece: i for i, p in enumerate(model.pieces) if kind[i] == 1}
    if len(kind) >= 1 << 20:
        raise ValueError("the model has 2^20 pieces or more")
    byte_ids = [i for i, k in kind.items() if k == 6]
    texts = tuple(
        p.piece.replace(SPACE, " ").encode() if kind[i] == 1 else bytes([int(p.piece[3:5], 16)]) if kind[i] == 6 else b" \xe2\x81\x87 " if kind[i] == 2 else b""
        for i, p in enumerate(model.pieces)
    )
    unknown = next(i for i, k in kind.items() if k == 2)
    return Pieces(normal, {p.piece: float(p.score) for i, p in enumerate(model.pieces) if kind[i] == 1}, byte_ids[0] if byte_ids else None, unknown, model.trainer_spec.model_type == 1, texts)


def as_unigram(pieces: Pieces) -> Pieces:
    """The same pieces as a unigram model, for which the fold is Viterbi: log-probabilities that fall with a piece's rank by Zipf's law."""
    order = sorted(pieces.ids, key=lambda p: (-pieces.scores[p], pieces.ids[p]))
    total = math.log(sum(1 / r for r in range(1, len(order) + 1)))
    return replace(pieces, unigram=True, scores={p: -math.log(r) - total for r, p in enumerate(order, 1)})


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id, score, rank; and an empty piece that gives every unit an edge, so units of unknown characters stay."""
    ranks = {score: r for r, score in enumerate(sorted(set(pieces.scores.values()), reverse=True))}
    rows = [(p, i, pieces.scores[p], ranks[pieces.scores[p]]) for p, i in pieces.ids.items()] + [("", 0, 0.0, 0)]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long")


def _fallback(pieces: Pieces, char: str) -> str:
    """SQL for the ids of one character that no piece has."""
    if pieces.first_byte is None:
        return f"array({pieces.unknown})"
    return f"transform(sequence(1, octet_length({char})), j -> {pieces.first_byte} + cast(conv(substring(hex({char}), 2 * j - 1, 2), 16, 10) as int))"


def encode_units(vocabulary: DataFrame, pieces: Pieces) -> DataFrame:
    """(hash, unit, slot, n) -> (slot, unit, n, ids): the lattice of each distinct unit of 1 to LONGEST characters, folded.

    A unit has one hash and one slot; a vocabulary that is partitioned by slot is not shuffled again.  The fold for BPE
    models reads the ids of single characters off the piece table when it puts the ids
    together, so there the edges of one character are left out of the join.
    """
    least = 1 if pieces.unigram else 2
    longest = max(2, pieces.longest)
    spans = (
        vocabulary.withColumn("size", F.length("unit"))
        .select(*KEYS, "n", "size", F.explode(F.expr(f"sequence(0, greatest(0, size - {least}))")).alias("b"))
        .select(*KEYS, "n", "b", F.explode(F.expr(f"sequence(if(b = 0, {least - 1}, {least}), least({longest}, size - b))")).alias("l"))
        .select(*KEYS, "n", "b", "l", F.expr(f"if(l < {least}, '', substring(unit, b + 1, l))").alias("piece"))
    )
    edges = spans.join(F.broadcast(piece_table(vocabulary.sparkSession, pieces)), "piece")  # as large as the model's vocabulary
    return _viterbi(edges, pieces) if pieces.unigram else _merges(edges, pieces)


def _merges(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """Edges get their masks and codes (start, then id in 20 bits) before they are grouped, where code generation reaches."""
    coded = edges.select(
        *KEYS, "n", "l",
        F.expr("shiftleft(rank, 6) | b").alias("turn"),
        F.expr("shiftleft(1L, b) | shiftleft(1L, b + l)").alias("ends"),
        F.expr("if(l > 1, shiftleft(shiftleft(1L, l - 1) - 1, b + 1), 0L)").alias("inner"),
        F.expr("shiftleft(cast(b as bigint), 20) | id").alias("code"),
    )
    grouped = coded.groupBy(*KEYS).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("l") > 1, F.struct("turn", "ends", "inner", "code")))).alias("edges"))
    # The mask of boundaries loses one bit a merge; it turns negative once no merge is left.
    mask = F.expr("""
        aggregate(if(length(unit) >= 2, sequence(2, length(unit)), cast(array() as array<int>)), shiftleft(1L, length(unit) + 1) - 1,
          (m, i) -> if(m < 0, m, m ^ coalesce(m & get(filter(edges, e -> (m & e.ends) = e.ends and bit_count(m & e.inner) = 1), 0).inner, shiftleft(1L, 63))),
          m -> m & ~shiftleft(1L, 63))""")
    single = sorted((i, p) for p, i in pieces.ids.items() if len(p) == 1)
    lost = (1 << 20) - 1  # stands for the id of a character that is no piece
    final = F.expr(f"""
        sort_array(concat(transform(filter(edges, e -> (mask & e.ends) = e.ends and (mask & e.inner) = 0), e -> e.code),
          transform(filter(sequence(0, length(unit) - 1), b -> (shiftright(mask, b) & 3) = 3),
            b -> shiftleft(cast(b as bigint), 20) | coalesce(get(single_ids, locate(substring(unit, b + 1, 1), singles) - 1), {lost}))))""")
    ids = F.expr(f"""
        if(exists(final, e -> (e & {lost}) = {lost}),
          flatten(transform(final, e -> if((e & {lost}) = {lost}, {_fallback(pieces, 'substring(unit, cast(shiftright(e, 20) as int) + 1, 1)')}, array(cast(e & {lost} as int))))),
          transform(final, e -> cast(e & {lost} as int)))""")
    return (
        grouped.withColumn("mask", mask)
        .withColumn("singles", F.lit("".join(p for _, p in single)))
        .withColumn("single_ids", F.lit([i for i, _ in single]).cast("array<int>"))
        .withColumn("final", final)
        .select("slot", "unit", "n", ids.alias("ids"))
    )


def _viterbi(edges: DataFrame, pieces: Pieces) -> DataFrame:
    worst = min(pieces.scores.values(), default=0.0) - UNKNOWN_PENALTY
    grouped = edges.groupBy(*KEYS).agg(F.first("n").alias("n"), F.collect_list(F.struct("b", "l", "id", "score")).alias("edges"))
    # A character that is no piece itself gets an edge of its own.
    unknown = F.expr(f"transform(filter(sequence(0, size - 1), b -> not exists(edges, e -> e.b = b and e.l = 1)), b -> named_struct('b', b, 'l', 1, 'id', -1, 'score', {worst!r}D))")
    start = "transform(sequence(0, size), p -> named_struct('score', if(p = 0, 0D, cast(null as double)), 'from', 0, 'id', 0))"
    table = F.expr(f"""
        aggregate(edges, {start}, (t, e) -> transform(t, (x, p) ->
          if(p = e.b + e.l and (x.score is null or get(t, e.b).score + e.score > x.score),
             named_struct('score', get(t, e.b).score + e.score, 'from', e.b, 'id', e.id), x)))""")
    path = F.expr("""
        aggregate(sequence(1, size), named_struct('at', size, 'steps', cast(array() as array<struct<b: int, id: int>>)),
          (acc, i) -> if(acc.at = 0, acc, named_struct('at', get(t, acc.at).from, 'steps',
             concat(array(named_struct('b', get(t, acc.at).from, 'id', get(t, acc.at).id)), acc.steps))), acc -> acc.steps)""")
    ids = F.expr(f"flatten(transform(path, s -> if(s.id >= 0, array(s.id), {_fallback(pieces, 'substring(unit, s.b + 1, 1)')})))")
    return (
        grouped.withColumn("size", F.length("unit"))
        .withColumn("edges", F.expr("filter(edges, e -> e.l > 0)"))
        .withColumn("edges", F.sort_array(F.concat("edges", unknown)))
        .withColumn("t", table)
        .withColumn("path", path)
        .select("slot", "unit", "n", ids.alias("ids"))
    )


def encode_unit(unit: str, pieces: Pieces) -> list[int]:
    """The same for one unit in plain code, for units too long for the fold; O(n log n) for BPE."""
    import heapq

    lost = (lambda c: [pieces.first_byte + b for b in c.encode()]) if pieces.first_byte is not None else (lambda c: [pieces.unknown])
    n = len(unit)
    if pieces.unigram:
        worst = min(pieces.scores.values(), default=0.0) - UNKNOWN_PENALTY
        best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * n
        for b in range(n):
            for size in range(1, min(pieces.longest, n - b) + 1):
                s = pieces.scores.get(unit[b : b + size], worst if size == 1 else None)
                if s is not None and (best[b + size] is None or best[b][0] + s > best[b + size][0]):
                    best[b + size] = (best[b][0] + s, b)
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        spans = list(zip(cuts[:0:-1], cuts[-2::-1]))
    else:
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (s := pieces.scores.get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-s, a, end[a], end[b]))

        for i in range(n):
            offer(i)
        alive = [True] * n
        while heap:
            _, a, middle, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[a], after[a] = stop, after[middle]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        spans = [(i, end[i]) for i in range(n) if alive[i]]
    return [i for a, b in spans for i in ([pieces.ids[unit[a:b]]] if unit[a:b] in pieces.ids else lost(unit[a:b]))]


def cut(texts: list[str], pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """The units of all texts, one after the other, and the number of units of each text."""
    kinds, beside = pieces.joins
    spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    line = "".join(spaced)
    ends = np.cumsum([len(t) for t in spaced], dtype=np.int64)
    if not line:
        return [], np.zeros(len(texts), np.int64)
    kind = kinds[np.frombuffer(line.encode("utf-32-le"), np.uint32)]
    apart = np.append(~beside[kind[:-1], kind[1:]], True)  # at i: between characters i and i + 1
    apart[ends[ends > 0] - 1] = True
    at = np.flatnonzero(apart) + 1
    marks = at.tolist()
    units = [line[a:b] for a, b in zip([0, *marks], marks)]
    return units, np.diff(np.searchsorted(at, ends, side="right"), prepend=0)


class _Numbers(dict):
    """A number for each unit, in the order of first sight."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def _thin(numbers: list[np.ndarray]) -> dict[str, pa.Array]:
    """Numbers below 2^32, in parts, as four compressed columns of their bytes: apart, these compress better.  Empties the list."""
    planes: list[list[bytes]] = [[], [], [], []]
    count = 0
    while numbers:
        flat = numbers.pop(0).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
        count += len(flat)
        for k, plane in enumerate(planes):
            plane.append(np.ascontiguousarray(flat[:, k]).tobytes())
    codec = pa.Codec("zstd", 6)
    out = {"size": pa.array([count])}
    for k in range(4):
        out[f"byte{k}"] = pa.array([codec.compress(b"".join(planes[k]), asbytes=True)], pa.large_binary())
        planes[k] = []
    return out


def _thick(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    count = batch.column(prefix + "size")[0].as_py()
    codec, out = pa.Codec("zstd"), np.empty((count, 4), np.uint8)
    for k in range(4):
        out[:, k] = np.frombuffer(codec.decompress(batch.column(f"{prefix}byte{k}")[0].as_buffer(), count), np.uint8) if count else 0
    return out.reshape(-1).view("<u4")


def _compressed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


class _Block:
    """Texts as numbers of distinct units, while a task reads them."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.units: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_ids: pa.Array, texts: list[str], pieces: Pieces) -> None:
        units, counts = cut(texts, pieces)
        self.units.append(np.fromiter(map(self.number.__getitem__, units), np.uint32, len(units)))
        self.counts.append(counts)
        self.doc_ids.append(doc_ids)
        self.held += sum(map(len, texts))

    def _ranked(self, rank: np.ndarray) -> list[np.ndarray]:
        for i, numbers in enumerate(self.units):
            self.units[i] = rank[numbers]
        return self.units

    def rows(self, block: int, pieces: Pieces, slots: int) -> pa.RecordBatch:
        """The block as rows of block, seq and pack, all of them short: whole rows of units (seq -1), and the rest in numbered parts.

        Units are in the order of their slots, then of code points: those of a slot are
        listed together, and neighbours are alike.  In the texts, a unit stands as its
        rank by frequency, so most numbers are small.
        """
        names = list(self.number)
        self.number.clear()
        slot = np.array([-1 if len(u) > LONGEST or u == SEPARATOR else zlib.crc32(u.encode()) % slots for u in names], np.int32)
        order = np.lexsort((np.asarray(pa.compute.rank(pa.array(names, pa.string()))), slot))  # place -> number of first sight
        uses = np.zeros(len(names), np.int64)
        for numbers in self.units:
            uses += np.bincount(numbers, minlength=len(names))
        often = np.argsort(-uses, kind="stable")  # rank -> number of first sight
        rank, place = np.empty(len(names), np.uint32), np.empty(len(names), np.uint32)
        rank[often] = np.arange(len(names), dtype=np.uint32)
        place[order] = np.arange(len(names), dtype=np.uint32)
        slot = slot[order]
        apart = int((slot < 0).sum())
        ids = pa.concat_arrays(self.doc_ids)
        rest = _compressed(
            {
                "doc_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "count": pa.array([np.concatenate(self.counts)]),
                "apart": pa.array([[encode_unit(names[i], pieces) for i in order[:apart].tolist()]], pa.list_(pa.list_(pa.int32()))),
                **_thin(self._ranked(rank)),
                **{"place" + k: v for k, v in _thin([place[often]]).items()},
            }
        )
        packs = [rest[at : at + SHORT] for at in range(0, len(rest), SHORT)]
        seqs = [*range(len(packs))]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        starts = starts[slot[starts] >= 0].tolist()
        listed: dict[str, list] = {"slot": [], "first": [], "units": []}
        held = 0
        for begin, end in zip(starts, [*starts[1:], len(names)]):
            joined = SEPARATOR.join([names[i] for i in order[begin:end].tolist()])
            for column, value in zip(listed.values(), (int(slot[begin]), (block << UNIT_BITS) + begin, joined)):
                column.append(value)
            held += len(joined)
            if held >= SHORT or end == len(names):
                packs.append(_compressed({"slot": pa.array(listed["slot"], pa.int32()), "first": pa.array(listed["first"], pa.int64()), "units": pa.array(listed["units"], pa.string())}))
                seqs.append(-1)
                listed, held = {"slot": [], "first": [], "units": []}, 0
        return pa.RecordBatch.from_pydict({"block": pa.array([block] * len(packs), pa.int64()), "seq": pa.array(seqs, pa.int32()), "pack": pa.array(packs, pa.binary())})


def _blocks(pieces: Pieces, slots: int):
    """An Arrow map: (doc_id, text) to (block, seq, pack), the block being this task's number and a number within it."""

    def run(batches):
        first = TaskContext.get().partitionId() << SEQ_BITS
        block, done = _Block(), 0
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pa.compute.binary_length(texts)).tolist()
            at = 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and held < CHUNK:
                    held += sizes[end]
                    end += 1
                block.add(batch.column(0).slice(at, end - at), texts.slice(at, end - at).to_pylist(), pieces)
                at = end
                if block.held >= BLOCK:
                    yield from _few(block.rows(first + done, pieces, slots))
                    block, done = _Block(), done + 1
        if block.counts:
            yield from _few(block.rows(first + done, pieces, slots))
        del block
        trim()

    return run


def _few(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (rows.slice(at, 4) for at in range(0, rows.num_rows, 4))


def _listed(batches):
    """An Arrow map: the rows of units as (slot, first, units): the units of a block in a slot, joined, and the place of their first."""
    for batch in batches:
        for seq, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if seq < 0:
                yield _unpack(blob)
    trim()


def _returned(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
    """The ids of the units of each block in a slot, in their order, as one compressed row a block."""
    lists = _one(dictionary.column("ids"))
    number = dict(zip(dictionary.column("unit").to_pylist(), range(dictionary.num_rows)))
    first, packs = rows.column("first").to_numpy(), []
    for units in rows.column("units").to_pylist():
        chosen = lists.take(pa.array(np.fromiter(map(number.__getitem__, units.split(SEPARATOR)), np.int64)))
        packs.append(_compressed({"length": pa.array([np.diff(chosen.offsets.to_numpy()).astype(np.uint32)]), **_thin([chosen.flatten().to_numpy(zero_copy_only=False)])}))
    del number, lists
    trim()
    return pa.table({"home": pa.array(first >> UNIT_BITS), "first": pa.array(first & ((1 << UNIT_BITS) - 1)), "ids": pa.array(packs, pa.binary())})


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _gathered(known: pa.Table, packs: pa.Table) -> pa.Table:
    """The ids of each document of a block, from the ids of its units."""
    rows = packs.filter(pa.compute.greater_equal(packs.column("seq"), 0)).sort_by("seq")
    if rows.column("seq").to_pylist() != [*range(rows.num_rows)]:
        raise RuntimeError(CHANGED)
    block = _unpack(b"".join(rows.column("pack").to_pylist()))
    parts = [_unpack(x) for x in known.sort_by("first").column("ids").to_pylist()]
    apart = block.column("apart").values
    lengths = np.concatenate([np.diff(apart.offsets.to_numpy()), *(p.column("length").values.to_numpy() for p in parts)]).astype(np.int64)
    if len(lengths) != block.column("placesize")[0].as_py():
        raise RuntimeError(CHANGED)
    values = np.concatenate([apart.flatten().to_numpy(zero_copy_only=False).astype(np.int32), *(_thick(p, "").astype(np.int32) for p in parts)])
    place = _thick(block, "place")
    lengths, starts = lengths[place].astype(np.int32), (np.cumsum(lengths) - lengths)[place]
    used = _thick(block, "")
    parts, sizes = [], [np.zeros(1, np.int32)]
    for at in range(0, len(used), PART):
        of = used[at : at + PART]
        size_of = lengths[of]
        before = np.cumsum(size_of) - size_of
        parts.append(values[np.repeat(starts[of] - before, size_of) + np.arange(size_of.sum())])
        sizes.append(size_of)
    upto = np.cumsum(np.concatenate(sizes), dtype=np.int32)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    cuts = np.append(0, upto[np.cumsum(block.column("count").values.to_numpy())]).astype(np.int32)
    whole = pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id").values, "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))})
    out = pa.Table.from_batches([whole.slice(at, LISTS) for at in range(0, whole.num_rows, LISTS)], whole.schema)
    del block, used, parts, sizes, upto, place, starts, lengths
    trim()
    return out


def encode(documents: DataFrame, pieces: Pieces, *, fixed: bool = False) -> DataFrame:
    """doc_id and ids (array of int) for every row of documents (doc_id, text); ids equal the library's.

    Each task packs its texts into blocks of about BLOCK characters: the distinct units,
    and the texts as their numbers, compressed.  The units of a block are dealt into slots
    by a hash.  In a slot, the distinct units of all blocks get their ids, which go
    back to their blocks, where the ids of documents are put together.  What is shuffled
    is the packed texts once and the distinct units of blocks there and back, never every
    occurrence.  A unit has at most one place a block, so frequent units are no hot keys.

    Blocks are known by the task and the order in which it reads them.  So documents
    must be the same rows in the same order whenever they are computed, as rows read from
    files are; say ``fixed`` for those.  Others are staged first.

    Null and empty texts have no ids.  Repeated rows each get their ids.  No rows: no
    rows.  A text's own U+2581 encodes like a space, as in the library.  Extra columns
    are ignored, whatever their names.  A text of any length is one row, so it must
    fit into a task's memory as numbers of units.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not fixed:
        docs = stage(docs, "sentencepiece-documents")
    kind = documents.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(_blocks(pieces, SPREAD * n), "block long, seq int, pack binary").repartition(n, "block")
    rows = dealt.mapInArrow(_listed, "slot int, first long, units string").repartition(SPREAD * n, "slot")
    listed = rows.select("slot", "first", F.posexplode(F.split("units", SEPARATOR)).alias("i", "unit")).select("slot", "unit", (F.col("first") + F.col("i")).alias("place"))
    # n is not needed, but makes both uses of the shuffle by slot read the same columns, so it is done once.
    vocabulary = listed.groupBy(F.xxhash64("unit").alias("hash"), "unit", "slot").agg(F.min("place").alias("n"))
    dictionary = encode_units(vocabulary, pieces).withColumnRenamed("slot", "of")
    back = rows.groupBy("slot").cogroup(dictionary.groupBy("of")).applyInArrow(_returned, "home long, first long, ids binary")
    return back.groupBy("home").cogroup(dealt.groupBy("block")).applyInArrow(_gathered, f"doc_id {kind}, ids array<int>")


def decode(ids, pieces: Pieces):
    """Column of the text of an array of ids: the pieces' bytes joined, less the leading space; null ids give null.

    An id that the model does not have, and a null among the ids, stand for nothing.
    Bytes that are no UTF-8 become U+FFFD.
    """
    table = [t or b"" for t in pieces.texts] + [b""]
    flat = np.frombuffer(b"".join(table), np.uint8)
    lengths = np.array([len(t) for t in table], np.int64)
    starts = np.cumsum(lengths) - lengths

    def texts(lists: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        code = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        code = np.where((code < 0) | (code >= len(table)), len(table) - 1, code)
        size_of = lengths[code]
        upto = np.append(0, np.cumsum(size_of))
        raw = flat[np.repeat(starts[code] - upto[:-1], size_of) + np.arange(upto[-1])].tobytes()
        cuts = upto[np.append(0, np.cumsum(sizes))].tolist()
        read = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return pa.array([(t[1:] if t.startswith(" ") else t) if known else None for t, known in zip(read, lists.is_valid().to_pylist())], pa.string())

    def run(lists: pa.Array) -> pa.Array:
        out = [texts(lists.slice(at, LISTS)) for at in range(0, len(lists), LISTS)]
        done = pa.concat_arrays(out) if out else pa.array([], pa.string())
        del out
        trim()
        return done

    # Annotated by name, for annotations of this module are strings.
    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)
