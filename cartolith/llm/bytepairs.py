"""Byte-level BPE encoding and decoding by a table of distinct words.

Encoding: tasks split their documents into words by the tokenizer's own pattern and number the distinct words
of a batch of documents; a batch becomes one row: its dictionary, and the words' numbers by position (the most
frequent words have the smallest numbers, packed). Only dictionaries are exploded, not positions, so a word
is shuffled once per batch of text and not once per occurrence. The dictionaries' words are grouped into the
table of distinct words, which is encoded word by word, each once, and sent back to the batches, where the
ids are joined to the positions. A word of very many batches is encoded once per PLACES of them, so that no
row gathers them all.

Decoding: id sequences are exploded by position and joined with the table of pieces (one row per id of the
vocabulary, whose size is fixed, so it is broadcast); pieces are joined in order. When a text is encoded this is
done for the sequences of the distinct words, and the decoded words go back to the positions beside the ids.

A word is never split differently on its own than inside its text, and control strings are cut out of the text
before it is split, so the ids are those of the tokenizer's plain call. Texts with characters on which the
pattern's library and the tokenizer may disagree are split by the tokenizer itself.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded
each; null ids of documents are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import fresh_path

#: Characters of text whose distinct words are numbered together.
BATCH_CHARS = 48 << 20
#: Batches of one partition at most: a batch's number is that of its partition times this, and its own.
BATCHES = 1 << 8
#: Batches that one row of the word table refers to at most.
PLACES = 4096
#: Places of words that a task deals to batches at once.
PLACES_AT_ONCE = 1 << 20
#: Longer texts are split in portions.
PORTION = 1 << 20

#: What sequences carry, their ids and their spellings.
Columns = tuple[pa.Array, pa.Array, pa.Array]


class Splitter:
    """Words of texts, as the tokenizer cuts them."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.normalizer is not None or self.tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("tokenizers that change the text before splitting are not supported")
        self.word = regex.compile(pattern)
        # the same pattern for texts of ASCII characters only, in the faster library
        self.ascii_word = re.compile(pattern.replace(r"\p{L}\p{N}]", "A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)
        controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.control = re.compile("(" + "|".join(map(re.escape, sorted(controls, key=len, reverse=True))) + ")") if controls else None

    def words(self, text: str) -> Iterator[list[str]]:
        """All words of a text in order, in lists."""
        if self.control is None or not self.control.search(text):
            yield from self._plain(text)
            return
        for k, part in enumerate(self.control.split(text)):
            if k % 2:
                yield [part]
            elif part:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > PORTION:
            # a space after another character that is not white space always starts a word
            cut = at + PORTION
            while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
                cut += 1
            yield self._split(text[at:cut])
            at = cut
        if at < len(text):
            yield self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        # on characters that Python's tables have, the pattern's library and the tokenizer agree (tested); newer ones are left to the tokenizer
        if text.isascii():
            return self.ascii_word.findall(text)
        if all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.word.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=1)
def splitter_of(vocabulary: str) -> Splitter:
    """One instance per worker process."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
    return Splitter(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, packed."""
    return packed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def dictionaries(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(batch, doc_ids, counts, codes, words): a batch's documents, their numbers of words, the words' numbers by position, and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(vocabulary)
        part, made = TaskContext.get().partitionId(), 0
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        docs, counts, codes, chars = [], [], [], 0

        def row() -> pa.RecordBatch:
            all_codes = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32)
            order = np.argsort(-np.bincount(all_codes, minlength=len(number)), kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            words = list(number)
            if made >= BATCHES:
                raise ValueError("a partition holds too many batches of documents: read it in smaller partitions")
            columns = [pa.array([part * BATCHES + made], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
            columns += [pa.array([packed_numbers(place[all_codes])], pa.binary()), pa.array([[words[k] for k in order.tolist()]], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["batch", "doc_ids", "counts", "codes", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                for doc, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    n = 0
                    for words in splitter.words(text or ""):
                        codes.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
                        n += len(words)
                    docs.append(doc)
                    counts.append(n)
                    chars += len(text or "")
                    if chars >= BATCH_CHARS:
                        yield row()
                        number.clear()
                        docs, counts, codes, chars, made = [], [], [], 0, made + 1
        if docs:
            yield row()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "batch long, doc_ids array<long>, counts array<long>, codes binary, words array<string>")


def distinct_words(batches: DataFrame, vocabulary: str) -> DataFrame:
    """(carried, ids): the table of distinct words, each encoded once; carried = the batches that hold the word (times 2^32), and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(vocabulary)
        for batch in batches:
            ids = pa.array(splitter.ids(batch.column(0).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), ids], ["carried", "ids"])

    rows = batches.select("batch", F.posexplode("words").alias("code", "word"))
    salts = -(-batches.count() // PLACES)  # one up to PLACES batches
    table = rows.groupBy("word", F.pmod(F.xxhash64("batch"), F.lit(max(1, salts)))).agg(F.collect_list(F.shiftleft("batch", 32) + F.col("code")).alias("places"))
    return table.select("word", "places").mapInArrow(run, "carried array<long>, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece): the bytes that every id stands for."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    letters = [b for b in range(256) if chr(b) in ByteLevel.alphabet()]
    others = [b for b in range(256) if b not in letters]
    byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(others)}
    control = {k: t.content.encode() for k, t in tokenizer.get_added_tokens_decoder().items()}
    rows = sorted((k, control.get(k) or bytes(byte[c] for c in piece)) for piece, k in tokenizer.get_vocab().items())
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "piece": pa.array([r[1] for r in rows], pa.binary())}))


def glued(parts: pa.Array, stops: np.ndarray) -> pa.Array:
    """Binary values joined in stretches that end before `stops`: the same bytes under fewer offsets."""
    bounds = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1]
    offsets = bounds[np.concatenate(([0], stops)).astype(np.int64)]
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.ascontiguousarray(offsets)), parts.buffers()[2] or pa.py_buffer(b"")])


def cut(data: bytes, lengths: np.ndarray) -> pa.Array:
    """Bytes as binary values of the given lengths."""
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def taken_lengths(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).to_numpy(zero_copy_only=False)


def spelled(sequences: DataFrame, vocabulary: str, schema: str | None = None, finish: Callable[[Iterator[Columns]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(carried, ids, spelling): the bytes of id sequences (carried, ids), by a join of every id with its piece.

    The pieces are broadcast, so the rows of a sequence stay in their partition and are gathered there, in any order.
    finish(columns), if given, turns the gathered sequences into rows of another schema in the same task.
    """
    kind = sequences.schema["carried"].dataType.simpleString()
    numbered = sequences.select(F.monotonically_increasing_id().alias("no"), "carried", "ids").select("no", "carried", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("at", "id"))
    first = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("carried"))
    rows = numbered.select("no", "n", "at", "id", first.alias("carried"))
    joined = rows.join(F.broadcast(pieces(sequences.sparkSession, vocabulary)), "id", "left").select("no", "n", "at", "id", "piece", "carried")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        left: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            no, n, at = (table.column(k).fill_null(0).to_numpy() for k in range(3))
            if not ((np.diff(no) > 0) | (np.diff(no) == 0) & (np.diff(at) > 0)).all():
                order = np.lexsort((at, no))
                table, no, n = table.take(order), no[order], n[order]
            starts = np.flatnonzero(np.diff(no, prepend=-1))
            sizes = np.diff(starts, append=len(no))
            whole = sizes == np.maximum(n[starts], 1)
            used = np.repeat(whole, sizes)
            left = table.filter(pa.array(~used)) if not used.all() else None
            if not whole.any():
                continue
            done = table.filter(pa.array(used)) if left is not None else table
            sizes = sizes[whole]
            stops = np.cumsum(sizes)
            carried, ids, parts = (pa.concat_arrays(done.column(k).chunks) for k in (5, 3, 4))
            some = n[starts][whole] > 0  # an empty sequence has one row without an id
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(some, sizes, 0)))), pa.int32()), ids.drop_null())
            yield carried.take(pa.array(stops - sizes)), lists, glued(parts.fill_null(b""), stops)
        if left is not None:
            raise RuntimeError("the pieces of a sequence lie in several partitions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if finish is not None:
            yield from finish(gathered(batches))
        else:
            yield from (pa.RecordBatch.from_arrays(list(columns), ["carried", "ids", "spelling"]) for columns in gathered(batches))

    return joined.mapInArrow(run, schema or f"carried {kind}, ids array<int>, spelling binary")


def decoded(sequences: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, decoded): the texts of id sequences (doc_id, ids); bytes that form no character become the replacement character."""
    found = spelled(sequences.select(F.col("doc_id").alias("carried"), F.col("ids").cast("array<int>").alias("ids")), vocabulary)
    return found.select(F.col("carried").alias("doc_id"), F.make_valid_utf8(F.col("spelling").cast("string")).alias("decoded"))


DEALT = "batch long, n long, codes binary, ends binary, ids binary, spans binary, spellings binary"
PACKED = DEALT.replace(" long", "").replace(" binary", "").split(", ")


def dealt(found: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
    """Ids and spellings of words for every batch that holds them, PLACES_AT_ONCE places at a time: n words of a batch by rising codes.

    codes holds their steps; ends and spans are lengths in bytes; all columns are packed.
    """
    held: list[Columns] = []

    def rows() -> pa.RecordBatch:
        places, ids, spellings = (pa.concat_arrays(list(c)) for c in zip(*held, strict=True))
        word = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
        place = places.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(place)
        place, word = place[order], word[order]
        bounds = np.flatnonzero(np.diff(place >> 32, prepend=-1, append=-1)).tolist()
        flat = ids.flatten()
        numbers = glued(cut(flat.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), np.full(len(flat), 4, dtype="<u4")), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            columns = [int(place[a] >> 32), b - a, packed_numbers(np.diff(place[a:b] & 0xFFFFFFFF, prepend=0))]
            for values, planes in ((numbers, True), (spellings, False)):
                taken = values.take(pa.array(word[a:b]))
                bytes_of = b"".join(taken.to_pylist())
                columns += [packed_numbers(taken_lengths(taken)), packed_numbers(np.frombuffer(bytes_of, dtype="<u4")) if planes else packed(bytes_of)]
            out.append(columns)
        kinds = [pa.int64()] * 2 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], PACKED)

    count = 0
    for columns in found:
        held.append(columns)
        count += len(columns[0].flatten())
        if count >= PLACES_AT_ONCE:
            yield rows()
            held, count = [], 0
    if count:
        yield rows()


def _by_position(documents: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one batch: ids and spellings of their words in order."""
    codes, ids, spellings = [np.zeros(0, dtype=np.int64)], [], []
    for steps, ends, numbers, spans, text in zip(*(words.column(c).to_pylist() for c in PACKED[2:]), strict=True):
        codes.append(np.cumsum(unpacked_numbers(steps), dtype=np.int64))
        ids.append(cut(unpacked_numbers(numbers).tobytes(), unpacked_numbers(ends)))
        spellings.append(cut(unpacked(text), unpacked_numbers(spans)))
    by_code = pa.array(np.argsort(np.concatenate(codes)))
    tables = [pa.concat_arrays(values).take(by_code) if values else pa.array([], pa.binary()) for values in (ids, spellings)]
    out = []
    for own, counts, numbers in zip(*(documents.column(c).to_pylist() for c in ("doc_ids", "counts", "codes")), strict=True):
        at, stops = pa.array(unpacked_numbers(numbers)), np.cumsum(counts)
        out.append(pa.table([pa.array(own, pa.int64()), *(glued(t.take(at), stops) for t in tables)], ["doc_id", "ids", "decoded"]))
    return pa.concat_tables(out)


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian uint32 bytes, and the text that they decode to."""
    spark = docs.sparkSession
    path = fresh_path(spark, "bpe-batches")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    # bucketed by batch, so that only the words travel when they are joined to the positions
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionaries(docs, vocabulary).write.bucketBy(buckets, "batch").option("path", path).option("compression", "zstd").saveAsTable(name)
    batches = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and the frame knows them
    words = spelled(distinct_words(batches, vocabulary), vocabulary, DEALT, dealt)
    left = batches.select("batch", "doc_ids", "counts", "codes").groupBy("batch")
    found = left.cogroup(words.groupBy("batch")).applyInArrow(_by_position, "doc_id long, ids binary, decoded binary")
    return found.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of the ids and of the text decoded from them."""
    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_bpe": op12_bpe}
SQL: dict[str, str] = {}
