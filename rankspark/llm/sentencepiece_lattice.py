"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into *segments* where no piece of the vocabulary can cross (before white-space marks,
between letters and other signs); each distinct segment of the corpus is encoded once:

1. its substrings of bounded length are exploded and equi-joined to the piece table;
2. each hit is an edge of the lattice; edges are single numbers, grouped by segment where the rows of
   the segment have met, and sorted by their ends;
3. a higher-order ``aggregate`` folds Viterbi over the edges.

The model's pieces come from merges, so the path wanted isn't the one of the best sum of scores but
the one whose adjacent pieces don't merge: two pieces may follow each other unless a piece that
crosses their boundary has a better score than the merges that closed its two halves off. For each
boundary exactly one last piece is admissible, which makes the fold as short as Viterbi's. Which
halves a piece has open, until which merge, and which pieces merge are tables of the vocabulary,
constants of the fold.

Segments of any length are folded with the states of the last ``WINDOW + LONGEST`` boundaries at
hand, so the time grows with the length.

Documents are worked on in chunks, scanned twice. The first scan gives each distinct segment of a
chunk with its place there; ids come back to the chunk packed. The second gives the texts as numbers
of their segments, which is what is shuffled, once, compressed. Nothing is written. Chunks are
numbered by the scan's partitions; the input must be a table scan, which deals its rows out alike
each time.

Decoding maps ids to pieces, byte pieces to their bytes and the mark to a space.

Defined cases: null and empty texts have no ids; characters that no piece has become byte pieces;
the mark U+2581 in a text decodes to a space, as in the library; null and repeated ids are rows
like any other; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.registry import query
from rankspark.llm.texts import row_slices, table, utf8

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Text bytes of a chunk, about.
CHUNK_BYTES = 16 << 20
#: Places that a task holds before it passes their ids on.
PACKED = 250_000
#: Longest piece, in characters.
LONGEST = 16
#: Characters of a segment that are spread, and boundaries that are put away, together.
WINDOW = 64
#: Rank of a merge that never comes; ranks are below it.
NEVER = (1 << 31) - 1
#: Id of a character that no piece has, until its bytes take its place.
RAW = (1 << 20) - 1
#: Steps back over a long segment that are listed together.
LISTED = 512
SEGMENT = regex.compile(rf"{MARK}*[\p{{L}}\p{{M}}]+|{MARK}*[^\p{{L}}\p{{M}}{MARK}]+|{MARK}+")


def model_text(text: str) -> str:
    """What the model reads: a space in front, marks for spaces; nothing for an empty text."""
    return (" " + text).replace(" ", MARK) if text else ""


def _merged(piece: str, rank: dict[str, int]) -> tuple:
    """The tree of merges that makes up a piece."""
    nodes: list[tuple] = [(c, None) for c in piece]
    while len(nodes) > 1:
        known = [(rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False)) if a[0] + b[0] in rank]
        if not known:
            raise ValueError(f"the merges don't reach the piece {piece!r}")
        _, i = min(known)
        nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], (nodes[i], nodes[i + 1]))]
    return nodes[0]


def _open_until(tree: tuple, side: int, rank: dict[str, int]) -> list[int]:
    """For each length, the rank of the merge that closes the part of that length at one end; -1 if there is no such part."""
    out = [-1] * len(tree[0])
    closed = NEVER
    while tree:
        out[len(tree[0]) - 1] = closed
        closed, tree = rank.get(tree[0], NEVER), tree[1] and tree[1][side]
    return out


def piece_table(model: str) -> list[tuple]:
    """(piece, id, rank, ends, begins) of the ordinary pieces; the vocabulary is bounded, and so is what is broadcast."""
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
    rank = {own.id_to_piece(i): int(-own.get_score(i)) for i in ids}
    rows = []
    for i in ids:
        piece = own.id_to_piece(i)
        if len(piece) > LONGEST or not SEGMENT.fullmatch(piece):
            raise ValueError(f"the piece {piece!r} is too long or crosses segments")
        tree = _merged(piece, rank)
        rows.append((piece, i, rank[piece], _open_until(tree, 1, rank), _open_until(tree, 0, rank)))
    return rows


def byte_ids(model: str) -> list[int]:
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    return [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# An item is one number: an edge is its end << 34 | where it starts << 27 | where it ends << 20 | id, these two among the boundaries
# that the fold holds then; so the longest edges of an end come first. A place of the segment is -1 - place.
def _bits(c: Column, at: int, n: int) -> Column:
    return (F.shiftright(c, at) if at else c).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _constant(rows: list, kind: str) -> Column:
    """A table of the vocabulary as a constant."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _merge_table(merges: list[tuple[int, int, int]], size: int) -> tuple[list[int], list[int]]:
    """(bases, slots): two pieces x and y that merge have bases[x] << 32 | rank in slot bases[x] + y; other slots are -1."""
    after: dict[int, list[tuple[int, int]]] = {}
    for x, y, rank in merges:
        after.setdefault(x, []).append((y, rank))
    rng, bases, used = np.random.default_rng(0), [-1] * size, set()
    slots = np.full(size + 4 * len(merges), -1, np.int64)
    for x, found in sorted(after.items(), key=lambda f: -len(f[1])):
        y, rank = np.array(found, np.int64).T
        while (base := int(rng.integers(len(slots) - size + 1))) in used or (slots[base + y] >= 0).any():
            pass
        used.add(base)
        bases[x], slots[base + y] = base, base << 32 | rank
    return bases, slots.tolist()


class _Fold:
    """The fold over the edges of a segment, in the order of their ends."""

    def __init__(self, pieces: list[tuple]):
        size = max((p[1] for p in pieces), default=0) + 1
        ids, right, left = {p[0]: p[1] for p in pieces}, [None] * size, [None] * size
        merges = [(ids[p[0][:k]], ids[p[0][k:]], p[2]) for p in pieces for k in range(1, len(p[0])) if p[0][:k] in ids and p[0][k:] in ids]
        bases, slots = _merge_table(merges, size)
        least: tuple[dict[int, int], dict[int, int]] = {}, {}
        for x, y, rank in merges:
            least[0][x], least[1][y] = min(rank, least[0].get(x, NEVER)), min(rank, least[1].get(y, NEVER))
        # The parts of a piece that its merges leave open at its right and left, with the rank of the merge that closes them;
        # without those that nothing merges with before.
        for piece, i, _, ends, begins in pieces:
            n = len(piece)
            right[i] = [bases[x] << 32 | ends[k - 1] for k in range(1, n + 1) if ends[k - 1] >= 0 and least[0].get(x := ids[piece[n - k :]], NEVER) < ends[k - 1]]
            left[i] = [y << 32 | begins[k - 1] for k in range(1, n + 1) if begins[k - 1] >= 0 and (y := ids[piece[:k]]) in least[1] and least[1][y] <= begins[k - 1]]
        self.right, self.left, self.slots = _constant(right, "array<array<bigint>>"), _constant(left, "array<array<bigint>>"), _constant(slots, "array<bigint>")

    def _merge(self, a: Column, b: Column) -> Column:
        """Whether an open part of piece ``a`` and one of the piece ``b`` behind it merge before they are closed."""
        rank = lambda c: c.bitwiseAND(F.lit(NEVER))

        def pair(x: Column, y: Column) -> Column:
            slot = F.get(self.slots, F.shiftright(x + y, 32))  # the ranks have 31 bits, so their sum doesn't reach the bases
            return (F.shiftright(slot, 32) == F.shiftright(x, 32)) & (slot < x) & (rank(slot) <= rank(y))

        return F.exists(F.get(self.right, a), lambda x: F.exists(F.get(self.left, b), lambda y: pair(x, y)))

    def path(self, edges: Column) -> Column:
        """The admissible edge that ends at each boundary, from the segment's begin; ``edges`` are sorted."""

        def step(state: Column, e: Column) -> Column:
            now, done, at = state["now"], state["done"], _bits(e, 20, 7)
            longer = F.concat(now, F.array(e))
            put_away = F.struct(F.slice(longer, WINDOW + 1, LONGEST + 1).alias("now"), F.concat(done, F.array(F.slice(longer, 1, WINDOW))).alias("done"))
            taken = F.when(at == WINDOW + LONGEST, put_away).otherwise(F.struct(longer.alias("now"), done.alias("done")))
            # Null, which is a character without a piece, merges with nothing.
            return F.when((F.size(now) != at) | self._merge(_bits(F.get(now, _bits(e, 27, 7)), 0, 20), _bits(e, 0, 20)), state).otherwise(taken)

        first = F.struct(F.array(F.lit(RAW).cast("long")).alias("now"), F.array().cast("array<array<bigint>>").alias("done"))
        return F.aggregate(edges, first, step, lambda s: F.concat(F.flatten(s["done"]), s["now"]))


def _back(states: Column) -> Column:
    """The edges on the path to the last boundary, from the edges that end at each."""
    empty = F.array().cast("array<bigint>")

    def step(state: Column, e: Column) -> Column:
        now = F.concat(state["now"], F.array(e))
        full = F.size(state["now"]) >= LISTED - 1
        taken = F.struct(
            (state["p"] - _bits(e, 20, 7) + _bits(e, 27, 7)).alias("p"), F.when(full, empty).otherwise(now).alias("now"),
            F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"))
        return F.when((state["p"] == F.shiftright(e, 34)) & (state["p"] > 0), taken).otherwise(state)

    first = F.struct((F.size(states) - 1).cast("long").alias("p"), empty.alias("now"), F.array().cast("array<array<bigint>>").alias("done"))
    found = F.aggregate(F.reverse(states), first, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.reverse(F.flatten(found))


def _with_bytes(path: Column, bytes_of: Column) -> Column:
    """Ids of a path, with the byte pieces of characters that no piece has. Needs the column ``segment``."""

    def raw(at: Column) -> Column:
        return _once(F.hex(F.substring("segment", at, F.lit(1)).cast("binary")), lambda code: F.transform(
            F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1),
            lambda i: F.get(bytes_of, F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))))

    own = lambda e: _bits(e, 0, 20).cast("int")
    one = lambda e: F.when(own(e) == RAW, raw(F.shiftright(e, 34).cast("int"))).otherwise(F.array(own(e)))
    return F.when(F.exists(path, lambda e: own(e) == RAW), F.flatten(F.transform(path, one))).otherwise(F.transform(path, own))


def _items(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(segment, item): the edges and the places of words (segment, places)."""
    n, at = F.length("segment").cast("long"), F.col("at")
    windows = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(WINDOW).cast("long"))
    spread = words.select("segment", F.explode(F.concat(windows, F.transform("places", lambda p: -1 - p))).alias("at"), n.alias("n"))
    # A window's characters with what a piece can reach beyond.
    text = F.when(at >= 0, F.substring("segment", at.cast("int") + 1, F.lit(WINDOW + LONGEST)))
    spread = spread.select("segment", "at", text.alias("text"), F.when(at >= 0, F.least(F.lit(WINDOW), n - at)).otherwise(1).cast("int").alias("n"))
    spread = spread.select("segment", "at", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    spread = spread.select("segment", (at + F.col("s")).alias("at"), F.substring("text", F.col("s") + 1, F.lit(LONGEST)).alias("ahead"))
    spread = spread.select("segment", "at", "ahead", F.explode(F.sequence(F.lit(1), F.coalesce(F.length("ahead"), F.lit(1)))).alias("k"))
    parts = spread.select("segment", "at", "k", F.substring("ahead", F.lit(1), F.col("k")).alias("part"))
    hits = parts.join(F.broadcast(pieces), F.col("part") == F.col("piece"), "left").where(F.col("id").isNotNull() | (F.col("k") == 1))
    end, held = at + F.col("k"), WINDOW + LONGEST
    there = F.when(end <= held, end).otherwise(LONGEST + 1 + (end - held - 1) % WINDOW)
    edge = F.shiftleft(end, 34).bitwiseOR(F.shiftleft(there - F.col("k"), 27)).bitwiseOR(F.shiftleft(there, 20)).bitwiseOR(F.coalesce("id", F.lit(RAW)).cast("long"))
    return hits.select("segment", F.when(at < 0, at).otherwise(edge).alias("item"))


def encode_places(rows: DataFrame, model: str) -> DataFrame:
    """(segment, places, ids) of each distinct segment of rows (segment, place); one exchange, where the rows of a segment meet."""
    table = piece_table(model)
    pieces = rows.sparkSession.createDataFrame([p[:2] for p in table], "piece string, id int")
    fold, bytes_of = _Fold(table), F.array(*map(F.lit, byte_ids(model)))
    words = rows.repartition("segment").groupBy("segment").agg(F.collect_list("place").alias("places"))
    # Edges come sorted by their ends; places, which are negative, before them.
    lists = _items(words, pieces).groupBy("segment").agg(F.sort_array(F.collect_list("item")).alias("items"))
    path = _once(fold.path(F.filter("items", lambda i: i >= 0)), _back)
    places = F.transform(F.filter("items", lambda i: i < 0), lambda i: -1 - i)
    return lists.select("segment", places.alias("places"), path.alias("path")).select("segment", "places", _with_bytes(F.col("path"), bytes_of).alias("ids"))


def encode_segments(segments: DataFrame, model: str) -> DataFrame:
    """(segment, ids) of distinct segments."""
    return encode_places(segments.select("segment", F.lit(0).cast("long").alias("place")), model).select("segment", "ids")


class _Chunk:
    """Some texts as numbers: ``sequence`` has the units of all texts, ``sizes`` how many each has, ``segments`` those of all units, sorted, ``spans`` and ``counts`` their numbers in each unit.

    A unit is a run of spaces with what follows it up to the next; segments don't cross units.
    """

    def __init__(self, number: int, ids: list, texts: list[bytes]):
        self.number, self.ids = number, ids
        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        texts.clear()
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[first] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.sequence = units.indices.to_numpy()
        self.sizes = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(lengths))))
        del data, begins, starts, offsets
        words = pc.replace_substring(units.dictionary.cast(pa.large_string()), " ", MARK).to_numpy(zero_copy_only=False).tolist()
        cuts, counts = [], np.ones(len(words), np.int32)
        for i, word in enumerate(words):
            if word[1:].isalpha():
                cuts.append(word)
            else:
                cuts += (cut := SEGMENT.findall(word))
                counts[i] = len(cut)
        self.counts = counts
        found = pa.array(cuts, pa.large_string()).dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        self.segments = found.dictionary.take(order)
        numbers = np.empty(len(order), np.int32)
        numbers[order.to_numpy()] = np.arange(len(order))
        self.spans = numbers[found.indices.to_numpy()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """The chunks of a partition; their numbers and those of their segments hold for every run of the scan."""
    number, ids, texts, size = TaskContext.get().partitionId() << 12, [], [], 0
    for batch in row_slices(batches, 256):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(b" " + text.replace(MARK.encode(), b" ") if text else text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield _Chunk(number, ids, texts)
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield _Chunk(number, ids, texts)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of int32, byte by byte of their numbers, compressed."""
    planes = [np.ascontiguousarray(a, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(arrays), *map(len, arrays)], "<i8").tobytes(), *planes]))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    out, at = [], 8 + 8 * n
    for size in np.frombuffer(data, "<i8", n, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * size, at).reshape(4, size).T).view("<i4").ravel())
        at += 4 * size
    return out


def _taken(values: np.ndarray, counts: np.ndarray, which: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which`` one behind the other, and how many values each has; the lists lie in ``values``, of ``counts`` each."""
    starts = np.cumsum(counts) - counts if starts is None else starts
    n = counts[which]
    return values[np.arange(n.sum()) + np.repeat(starts[which] - (np.cumsum(n) - n), n)], n


def encode(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for every row of a scanned table (columns doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            for s in range(0, len(chunk.segments), 20_000):
                some = chunk.segments.slice(s, 20_000)
                yield pa.record_batch({"segment": some.cast(pa.string()), "place": pa.array(np.arange(s, s + len(some)) + (chunk.number << 28))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            places, counts, ids = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(places)
            ids, counts = _taken(ids, counts, order)
            chunks, first = np.unique(places[order] >> 28, return_index=True)
            numbers, ends = (places[order] & ((1 << 28) - 1)).astype(np.int32), np.append(0, np.cumsum(counts))
            limits = np.append(first, len(places))
            blobs = [_pack(np.diff(numbers[a:b], prepend=0), counts[a:b], ids[ends[a] : ends[b]]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            return pa.record_batch({"chunk": pa.array(chunks, pa.int64()), "known": pa.array(blobs, pa.binary())})

        for batch in row_slices(batches, 4096):
            places, ids = batch.column("places"), batch.column("ids")
            counts = ids.value_lengths().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(counts)), places.value_lengths().to_numpy())
            values, counts = _taken(ids.flatten().to_numpy(), counts, of)
            held.append((places.flatten().to_numpy(), counts, values))
            size += len(of)
            if size >= PACKED:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            yield pa.record_batch({
                "chunk": pa.array([c.number]), "doc_ids": pa.array([c.ids], pa.list_(pa.int64())), "sizes": pa.array([c.sizes], pa.list_(pa.int32())),
                "texts": pa.array([_pack(c.sequence, c.spans, c.counts)], pa.binary())})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 1):
            sequence, spans, per_unit = _unpack(batch.column("texts")[0].as_py())
            known = [_unpack(blob) for blob in batch.column("known")[0].as_py() or ()]
            if known:
                numbers, counts, ids = (np.concatenate(x) for x in zip(*((np.cumsum(n), c, i) for n, c, i in known), strict=True))
                ids, counts = _taken(ids, counts, np.argsort(numbers))
                ids, n = _taken(ids, counts, spans)
                ends = np.append(0, np.cumsum(n))
                per_unit = np.diff(ends[np.append(0, np.cumsum(per_unit))])
            else:
                ids = np.zeros(0, np.int32)
            starts = np.cumsum(per_unit) - per_unit
            doc_ids, ends = batch.column("doc_ids").flatten(), np.append(0, np.cumsum(batch.column("sizes").flatten().to_numpy()))
            for s in range(0, len(doc_ids), 256):
                limits = ends[s : s + 257]
                values, n = _taken(ids, per_unit, sequence[limits[0] : limits[-1]], starts)
                lengths = np.append(0, np.cumsum(n))[limits - limits[0]].astype(np.int32)
                yield pa.record_batch({"doc_id": doc_ids.slice(s, 256), "ids": pa.ListArray.from_arrays(pa.array(lengths), pa.array(values, pa.int32()))})

    coded = encode_places(rows.mapInArrow(segments, "segment string, place long"), model).select("places", "ids")
    known = coded.mapInArrow(packed, "chunk long, known binary").groupBy("chunk").agg(F.collect_list("known").alias("known"))
    texts = rows.mapInArrow(texts_of, "chunk long, doc_ids array<long>, sizes array<int>, texts binary")
    return texts.join(known, "chunk", "left").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(ids: Column, model: str) -> Column:
    """The text of each list of ids."""
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [
        bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i)
        else own.id_to_piece(i).replace(MARK, " ").encode() for i in range(own.get_piece_size())]

    table = pa.array(pieces, pa.large_binary())

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                found = []
                rows = batch.slice(s, 256)
                joined = table.take(rows.flatten())
                data = joined.buffers()[2]
                limits = np.frombuffer(joined.buffers()[1], np.int64)[np.append(0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy()))].tolist()
                for a, b in zip(limits[:-1], limits[1:], strict=True):
                    text = data[a:b].to_pybytes() if b > a else b""
                    found.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
                yield pa.array(found, pa.string())

    return texts(ids)


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and a hash of what they decode to."""
    model = public_tokenizers.path(MODEL)
    found = encode(table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(decode(F.col("ids"), model).cast("binary"), 256).alias("decoded_sha256"))
