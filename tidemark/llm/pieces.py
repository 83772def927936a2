"""SentencePiece encoding through a table of distinct marked words, each segmented once, and decoding."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import pick
from tidemark.sources.tables import stored

MARK = "▁"  # what the library makes of a space
BLOCK = 8 << 20  # bytes of text whose words travel together
BUCKET = 32 << 20  # bytes of text per bucket of words
BUCKETS = 64  # at least
DIFFERS = "the rows came in another order when they were read again; call with repeatable=False"


def processor(model: str):
    """The library's processor, if its pieces allow each marked word to be segmented apart; else an error."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"{len(crossing)} pieces cross a whitespace marker, for example {crossing[0]!r}")
    probe = " a\t  b　Ａﬁ  "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK) or sp.normalize("") != "":
        raise ValueError("the model normalises texts in another way than by marking spaces")
    return sp


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed string, each behind its length."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    body = b"".join([np.array([len(raw), *map(len, raw)], np.int64).tobytes(), *raw])
    return np.int64(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[bytes]:
    body = pa.decompress(packed[8:], int(np.frombuffer(packed[:8], np.int64)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(body[:8], np.int64)[0])
    ends = np.cumsum(np.frombuffer(body[8:8 + 8 * n], np.int64)) + 8 + 8 * n
    return [body[a:b] for a, b in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist())]


def _planes(a: np.ndarray) -> list[np.ndarray]:
    """Numbers below 2^32 as their four bytes apart: bytes of one kind compress better."""
    return [((a >> shift) & 255).astype(np.uint8) for shift in (0, 8, 16, 24)]


def _whole(planes: list[bytes]) -> np.ndarray:
    return sum(np.frombuffer(p, np.uint8).astype(np.int64) << (8 * i) for i, p in enumerate(planes))


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The marked words of all texts without their first marker, and how many each text has.

    The library puts a marker before a text that is not empty and makes one of every space. A marked word is a run of
    markers and what follows it up to the next marker, so the first one of a text is all before the first space that does
    not stand behind another one. Without its first marker a word is a text that the library marks the same way.
    """
    texts = pc.replace_substring(texts, pattern=MARK, replacement=" ")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    keep = ~begins
    begins[starts], keep[starts] = True, True
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(data))) - ~keep[at]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    ends = np.cumsum(lengths)
    return words, np.searchsorted(at, ends) - np.searchsorted(at, ends - lengths)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BLOCK`` bytes of text; a longer text is alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        first = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > BLOCK:
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, first = [], 0, i
            size += n + 16  # rows without text count too
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _split(rows: DataFrame, buckets: int, words: bool) -> DataFrame:
    """(block, bucket, body) of each block of rows: its distinct words by bucket of their hash, or else its places (bucket -1).

    A block is named by its task, its number there and its content.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(_blocks(batches)):
            found, per_row = marked_words(batch.column("text"))
            name = xxhash.xxh3_64_intdigest(found.buffers()[2], xxhash.xxh3_64_intdigest(f"{task}:{number}"))
            name = name - (1 << 64) if name >> 63 else name
            coded = found.dictionary_encode()
            place, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            often = np.argsort(-np.bincount(place, minlength=len(known)), kind="stable")  # frequent words get small numbers
            known = known.take(pa.array(often)).to_pylist()
            of = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in known), np.int64, len(known))
            if words:
                order = np.argsort(of, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
                names, bodies = [int(of[some[0]]) for some in parts], []
                for some in parts:
                    mine = [known[i] for i in some.tolist()]
                    bodies.append(_pack(*_planes(np.array([len(w) for w in mine])), b"".join(mine)))
            else:
                rank = np.empty(len(known), np.int64)
                rank[often] = np.arange(len(known))
                sink = pa.BufferOutputStream()
                others = batch.drop_columns(["text"])
                with pa.ipc.new_stream(sink, others.schema) as writer:
                    writer.write_batch(others)
                names, bodies = [-1], [_pack(sink.getvalue().to_pybytes(), *_planes(per_row), *_planes(of), *_planes(rank[place]))]
            for a in range(0, len(names), 32):
                n = len(names[a:a + 32])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.int64()), pa.array(names[a:a + 32], pa.int32()), pa.array(bodies[a:a + 32], pa.binary())],
                    ["block", "bucket", "body"])

    return rows.mapInArrow(work, "block long, bucket int, body binary")


def _segmented(words: DataFrame, model: str) -> DataFrame:
    """(block, bucket, body) with ids for words. A bucket's rows come together, so each of its words is segmented once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, now, table = processor(model), None, {}
        for batch in batches:
            out = []
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
                if bucket != now:
                    now, table = bucket, {b"": [sp.piece_to_id(MARK)]}  # a marker alone
                *lengths, data = _unpack(body)
                ends = np.cumsum(_whole(lengths)).tolist()
                mine = [data[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in mine if w not in table]
                table.update(zip(new, sp.encode([w.decode("utf-8") for w in new], num_threads=1)))
                ids = [table[w] for w in mine]
                out.append(_pack(*_planes(np.fromiter(map(len, ids), np.int64, len(ids))),
                                 *_planes(np.fromiter(itertools.chain.from_iterable(ids), np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "body"])

    together = words.repartition("bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(work, "block long, bucket int, body binary")


def _joined(parts: list[list[bytes]], of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in the order of their places, and the number of ids of each place; ``of`` are the words' buckets."""
    lengths = np.concatenate([_whole(p[:4]) for p in parts])
    ids = np.concatenate([_whole(p[4:]) for p in parts]).astype(np.int32)
    local = np.argsort(of, kind="stable")  # the order in which the parts have the words
    start, size = np.empty(len(local), np.int64), np.empty(len(local), np.int64)
    start[local], size[local] = np.cumsum(lengths) - lengths, lengths
    each = size[place]
    ends = np.cumsum(each)
    return ids[np.repeat(start[place] - (ends - each), each) + np.arange(ends[-1])], each


def encode(docs: DataFrame, model: str, carry: tuple[str, ...] = (), repeatable: bool = False) -> DataFrame:
    """(doc_id, carried columns, ids, decoded): what the library's encode makes of every whole text, and its decode of that.

    A null or empty text has no ids. Repeated rows and null ids are rows like any other. Texts of any length: one is split
    at its markers only, and a text longer than a block travels alone. Each task turns blocks of rows into places and
    distinct words; the words of all blocks meet by hash, are segmented once, and go back to their blocks, which are then
    put together by place. Every word of a block is one entry, however often it stands there.

    The rows are read once for their words and once for their places, which spares writing either. So they must come in the
    same order both times, as those of a table do: say so with ``repeatable``, else they are written first. Blocks whose
    words do not return, because they came in another order after all, raise.
    """
    processor(model)  # fails early where words cannot be segmented apart
    names = ["doc_id", *[c for c in carry if c not in ("doc_id", "text")]]
    rows = pick(docs, "text", *names).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if not repeatable:
        rows = stored(rows, "texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, size // BUCKET)
    ids = _segmented(_split(rows, buckets, words=True), model)
    schema = StructType([rows.schema[n] for n in names]
                        + [StructField(f.name, f.dataType) for f in StructType.fromDDL("ids array<int>, decoded string")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, head, parts, now = processor(model), None, [], None

        def whole() -> Iterator[pa.RecordBatch]:
            others, *planes = _unpack(head)
            per_row, of, place = (_whole(planes[i:i + 4]) for i in (0, 4, 8))
            if sum(len(p[0]) for p in parts) != len(of):
                raise RuntimeError(DIFFERS)
            ids, each = _joined(parts, of, place) if len(place) else (np.empty(0, np.int32), np.empty(0, np.int64))
            bounds = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_row)])].tolist()
            kept = pa.ipc.open_stream(others).read_all().combine_chunks().to_batches()[0]
            for a in range(0, len(per_row), 512):
                b = min(a + 512, len(per_row))
                lists = [ids[s:e].tolist() for s, e in zip(bounds[a:b], bounds[a + 1:b + 1])]
                columns = [kept.column(n).slice(a, b - a) for n in names]
                flat = pa.ListArray.from_arrays(pa.array(np.array(bounds[a:b + 1]) - bounds[a], pa.int32()), pa.array(ids[bounds[a]:bounds[b]]))
                yield pa.RecordBatch.from_arrays(
                    [*columns, flat, pa.array([sp.decode(x) if x else "" for x in lists], pa.string())], names=arrow.names)

        for batch in batches:
            for block, bucket, body in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "body"))):
                if block != now:
                    if now is not None:
                        yield from whole()
                    if bucket != -1:
                        raise RuntimeError(DIFFERS)
                    now, head, parts = block, body, []
                else:
                    parts.append(_unpack(body))
        if now is not None:
            yield from whole()

    by_block = _split(rows, buckets, words=False).unionAll(ids).repartition("block").sortWithinPartitions("block", "bucket")
    return by_block.mapInArrow(work, schema)
