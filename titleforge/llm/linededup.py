"""Line dedup (operator 2): a once-seen and a twice-seen Bloom filter; only lines suspected of repeating are shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from titleforge.llm import lines as ln
from titleforge.llm import textvec as tv
from titleforge.llm.common import cut, doc_key, file_system, id_of, id_type, packed, shared_dir, ship, unpacked

SHARD_BITS = 16
_SPACE = " \t\r"


def filter_bits(n_lines: int, bits_per_line: int) -> int:
    """A power of two, of at least 2**20 bits: the filter follows the number of lines."""
    return 1 << max(20, int(max(1, n_lines * bits_per_line) - 1).bit_length())


def positions(hashes: np.ndarray, bits: int, k: int, block: int) -> np.ndarray:
    """The k filter bits of each hash, by double hashing, all in one block of at most ``block`` bits, which the hash's highest bits name."""
    h = hashes.view(np.uint64)
    size = min(bits, block)
    step = ((h >> np.uint64(33)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    base = block_of(h, bits, block).astype(np.uint64) * np.uint64(size)
    return np.stack([base + ((h + np.uint64(j) * step) & np.uint64(size - 1)) for j in range(k)])


def block_of(h: np.ndarray, bits: int, block: int) -> np.ndarray:
    blocks = max(1, bits // block)
    return (h >> np.uint64(64 - (blocks.bit_length() - 1))).astype(np.int64) if blocks > 1 else np.zeros(len(h), dtype=np.int64)


def _containers(pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted bit positions by shard: 2 bytes a bit, or a bitmap where that is shorter."""
    size = 1 << SHARD_BITS
    shard = pos >> SHARD_BITS
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for own in np.split(pos, cuts) if len(pos) else []:
        low = (own & (size - 1)).astype(np.uint16)
        if len(low) * 2 < size // 8:
            yield int(own[0] >> SHARD_BITS), low.tobytes()
        else:
            bits = np.zeros(size, dtype=np.uint8)
            bits[low] = 1
            yield int(own[0] >> SHARD_BITS), np.packbits(bits, bitorder="little").tobytes()


def _bitmap(container: bytes) -> np.ndarray:
    if len(container) == 1 << (SHARD_BITS - 3):
        return np.frombuffer(container, dtype=np.uint8)
    bits = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
    bits[np.frombuffer(container, dtype=np.uint16)] = 1
    return np.packbits(bits, bitorder="little")


_PART = T.StructType([T.StructField("shard", T.LongType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_LINE = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("line", T.StringType())]))
#: Bit positions that a task gathers before it sends them on.
BUFFER = 1_000_000


def twice_seen(texts: DataFrame, bits: int, k: int, block: int) -> DataFrame:
    """(shard, twice): the shards of the twice-seen filter of all lines (column t) that have a bit, 2**SHARD_BITS bits each.

    Each task marks which bits its lines set once, and which more than once, and sends them by shard, a bounded number at
    a time. Shards meet their parts: a bit is seen twice if a part says so or if two parts have seen it once. So every
    bit of a line that occurs twice is in the result, wherever the two are.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pos, n = np.unique(np.concatenate(held), return_counts=True)
            parts: dict[int, list[bytes | None]] = {}
            for slot, own in enumerate((pos, pos[n > 1])):
                for shard, c in _containers(own.astype(np.int64)):
                    parts.setdefault(shard, [None, None])[slot] = c
            yield pa.RecordBatch.from_arrays([pa.array([*parts], pa.int64()), pa.array([p[0] for p in parts.values()], pa.binary()), pa.array([p[1] for p in parts.values()], pa.binary())], ["shard", "once", "twice"])

        held: list[np.ndarray] = []
        for b in batches:
            for part in ln.lines(*tv.text_bytes(b.column(0))):
                held.append(positions(part.hash, bits, k, block).reshape(-1))
                if sum(map(len, held)) > BUFFER:
                    yield from sent(held)
                    held = []
        if sum(map(len, held)):
            yield from sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for shard, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                o = _bitmap(once)
                if shard not in seen:
                    seen[shard] = [o.copy(), np.zeros_like(o)]
                else:
                    s = seen[shard]
                    s[1] |= s[0] & o
                    s[0] |= o
                if twice is not None:
                    seen[shard][1] |= _bitmap(twice)
        keep = {k: v[1] for k, v in seen.items() if v[1].any()}
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([*keep], pa.int64()), pa.nulls(len(keep), pa.binary()), pa.array([v.tobytes() for v in keep.values()], pa.binary())], ["shard", "once", "twice"])

    return texts.mapInArrow(build, _PART).repartition("shard").mapInArrow(merge, _PART).select("shard", "twice")


def _hit(filt: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (filt[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def by_broadcast(docs: DataFrame, text: Column, filt: DataFrame, bits: int, k: int) -> tuple[Column, Column]:
    """Columns of a text: the places of its suspected lines, and these with the lines. The whole filter goes to every worker."""
    out = np.zeros((max(1, bits >> SHARD_BITS), 1 << (SHARD_BITS - 3)), dtype=np.uint8)
    for shard, bitmap in filt.toLocalIterator():
        out[shard] = np.frombuffer(bytes(bitmap), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(out.reshape(-1).tobytes())

    def suspects(texts: pa.Array) -> Iterator[tuple[np.ndarray, ln.Lines]]:
        filt = np.frombuffer(shared.value, dtype=np.uint8)
        data, offs = tv.text_bytes(texts)
        for x in ln.lines(data, offs):
            at = np.flatnonzero(_hit(filt, positions(x.hash, bits, k, bits)))
            yield data, ln.Lines(x.doc[at], x.place[at], x.start[at], x.end[at], x.hash[at])

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(texts: pa.Array) -> pa.Array:
        found = [x for _, x in suspects(texts)]
        return ln.lists(pa.array(joined([x.place for x in found]), pa.int32()), joined([x.doc for x in found]), len(texts))

    @F.arrow_udf(_LINE)
    def lines(texts: pa.Array) -> pa.Array:
        found = [(ln.strings(data, x.start, x.end), x) for data, x in suspects(texts)]
        line = pa.chunked_array([s for s, _ in found], pa.string()).combine_chunks()
        line = line.combine_chunks() if isinstance(line, pa.ChunkedArray) else line
        pairs = pa.StructArray.from_arrays([pa.array(joined([x.place for _, x in found]), pa.int32()), line], ["i", "line"])
        return ln.lists(pairs, joined([x.doc for _, x in found]), len(texts))

    return places.asNondeterministic()(text), lines.asNondeterministic()(text)  # so that filters pushed below don't run them again


def by_block(docs: DataFrame, id_col: str, text_col: str, filt: DataFrame, bits: int, k: int, block: int) -> DataFrame:
    """(id, th, at): the places of the suspected lines of each (doc_id, text) that has any. 8-byte hashes go to where their block of the filter lies.

    The filter is a table in the shared folder, parted by block. Hashes are rebalanced by block, so that a block that many
    ask (a line that is everywhere) is dealt out to several tasks; each task reads the blocks it is asked for.
    """
    folder = f"{shared_dir(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    per_block = (block >> SHARD_BITS).bit_length() - 1
    filt.select("shard", "twice", F.shiftright("shard", per_block).alias("block")).write.partitionBy("block").parquet(folder)
    kind = id_type(docs, id_col)
    asked = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("block", T.LongType())])
    names = asked.names

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in ln.lines(*tv.text_bytes(b.column(2))):
                at = pa.array(x.doc)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(x.place, pa.int32()), pa.array(x.hash.view(np.int64)), pa.array(block_of(x.hash, bits, block))], names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def load(number: int) -> np.ndarray:
            if number not in held:
                held.clear()  # one block at a time is in memory
                system, root = file_system(folder)
                out = np.zeros((1 << per_block, 1 << (SHARD_BITS - 3)), dtype=np.uint8)
                at = f"{root}/block={number}"
                if system.get_file_info(at).type != pafs.FileType.NotFound:
                    for f in system.get_file_info(pafs.FileSelector(at)):
                        if f.path.endswith(".parquet"):
                            t = pq.read_table(f.path, filesystem=system, columns=["shard", "twice"], partitioning=None)
                            for shard, bitmap in zip(t.column("shard").to_pylist(), t.column("twice").to_pylist()):
                                out[shard & ((1 << per_block) - 1)] = np.frombuffer(bitmap, dtype=np.uint8)
                held[number] = out.reshape(-1)
            return held[number]

        for b in batches:
            own = b.column(4).to_numpy()
            h = b.column(3).to_numpy().view(np.uint64)
            ok = np.zeros(len(own), dtype=bool)
            for number in np.unique(own):
                at = np.flatnonzero(own == number)
                pos = positions(np.ascontiguousarray(h[at]), bits, k, block) - np.uint64(int(number) * block)
                ok[at] = _hit(load(int(number)), pos)
            if ok.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in b.columns], names)

    text = F.col(f"`{text_col}`")
    rows = docs.select(id_of(docs, id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).filter(F.col("t").isNotNull())
    hit = rows.mapInArrow(ask, asked).hint("rebalance", "block").sortWithinPartitions("block").mapInArrow(answer, asked)
    return hit.groupBy("id", "th").agg(F.array_sort(F.collect_set("i")).alias("at"))


@F.arrow_udf(_LINE)
def _lines_at(texts: pa.Array, at: pa.Array) -> pa.Array:
    """The lines of each text at the places given."""
    out = []
    for t, places in zip(texts.to_pylist(), at.to_pylist()):
        parts = t.split("\n") if places else []
        out.append([{"i": i, "line": parts[i].strip(_SPACE)} for i in places or []])
    return pa.array(out, pa.list_(pa.struct([pa.field("i", pa.int32()), pa.field("line", pa.string())])))


@F.arrow_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("n", T.IntegerType())]))
def _without(texts: pa.Array, at: pa.Array, firsts: pa.Array) -> pa.Array:
    """Each text without its lines ``at`` but those that are ``firsts``, and how many went."""
    gone = [np.setdiff1d(np.array(a or [], dtype=np.int64), np.array(f or [], dtype=np.int64)) for a, f in zip(at.to_pylist(), firsts.to_pylist())]
    clean = [ln.without(t, g) for t, g in zip(texts.to_pylist(), gone)]
    return pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.array([len(g) for g in gone], pa.int32())], ["clean", "n"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_line: int = 16, n_hashes: int = 3, block_bits: int = 31) -> DataFrame:
    """docs packed as ``row``, with ``clean`` (the text without lines that occurred before), ``n_lines`` and ``n_removed``.

    A line is removed if an equal line (ends trimmed) occurs earlier: in a document with a lower doc_id, or earlier in
    the same document. Blank lines always stay. The filters have bits_per_line bits a line, however many lines there are;
    lines that the twice-seen filter doesn't have are unique, and their text is never shuffled. Suspected lines are grouped
    by their whole text, so a false positive or a hash collision changes nothing; each group's first occurrence goes
    back to its document, and only documents with suspected lines move, their text once. All steps are linear in the lines.

    A filter of up to 2**block_bits bits is broadcast to the tasks that scan (its size follows from the lines, which are
    counted first). A larger one stays in the shared folder in blocks of that size, and the lines' 8-byte hashes are
    shuffled to their block; then all documents are joined with their suspects by a shuffle. The result is the same.

    Defined cases: a null text stays null and has 0 lines; '' has 1 (blank) line; ids may be numbers or texts; rows
    without doc_id come last, in the order of their text's hash; of rows equal in doc_id and text, one counts as first and
    the others lose their repeated lines; extra columns are carried in ``row``; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    text, kind = F.col(f"`{text_col}`"), id_type(docs, id_col)
    count = F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1
    texts = docs.select(text.alias("t")).filter(F.col("t").isNotNull())
    n_lines = texts.agg(F.sum(count)).first()[0] or 0
    bits, block = filter_bits(n_lines, bits_per_line), 1 << block_bits
    filt = twice_seen(texts, bits, n_hashes, block)
    keyed = {"key": doc_key(id_of(docs, id_col), F.xxhash64(text), kind), "t": text}
    if bits <= block:
        places, lines = by_broadcast(docs, F.col("t"), filt, bits, n_hashes)
        marked = packed(docs, **keyed).withColumn("at", places)
        told = docs.select(*[v.alias(k) for k, v in keyed.items()]).select("key", lines.alias("told"))
    else:
        sus = cut(by_block(docs, id_col, text_col, filt, bits, n_hashes, block)).select(doc_key(F.col("id"), F.col("th"), kind).alias("s"), "at")
        marked = packed(docs, **keyed).join(sus, F.col("key") == F.col("s"), "left").drop("s")
        told = marked.filter("at is not null").select("key", _lines_at(F.col("t"), F.col("at")).alias("told"))
    told = told.select("key", F.explode("told").alias("x")).select("key", F.col("x.i").alias("i"), F.col("x.line").alias("line"))
    first = told.groupBy("line").agg(F.min(F.struct("key", "i")).alias("f"))
    kept = first.groupBy(F.col("f.key").alias("key")).agg(F.collect_list("f.i").alias("firsts"))
    some = F.size(F.coalesce("at", F.array().cast("array<int>"))) > 0
    moved = marked.filter(some).select("row", "key", "at")  # the text is in row
    joined = moved.join(kept, "key", "left").withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    own = F.col("row").getField(text_col)
    changed = joined.select("row", _without(own, F.col("at"), F.when(F.col("copy") == 1, F.col("firsts"))).alias("w"))
    t = F.col("row").getField(text_col)
    lines_of = F.coalesce(F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines")
    cleaned = changed.select("row", F.col("w.clean").alias("clean"), lines_of, F.col("w.n").alias("n_removed"))
    same = marked.filter(~some).select("row", t.alias("clean"), lines_of, F.lit(0).alias("n_removed"))
    return same.unionByName(cleaned)


def deduped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row of documents."""
    d = dedup_lines(docs)
    return d.select(F.col("row.doc_id").alias("doc_id"), F.col("clean").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))


def stage(docs: DataFrame) -> DataFrame:
    """The columns of docs with the repeated lines gone from text and n_chars set anew; documents of which nothing but blank lines is left go, if lines were removed."""
    d = dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.btrim("clean", F.lit(_SPACE + "\n")) != ""))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(d, docs.columns, **changed)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' OR
         row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(13)) ORDER BY doc_id, i) = 1 AS keep FROM l),
c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (keep) AS text, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM c
"""
