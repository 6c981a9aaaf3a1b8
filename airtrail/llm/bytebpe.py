"""Byte-level BPE: ranked merges folded by Spark expressions over the bytes of distinct words, with a literal rank map; decoding by pieces.

Inside the fold a token is one sign: the character of its id, with the surrogates left out (``sign``); the tokens of a word are a string of signs.
Merging a pair is then cutting and joining strings, and the map from a pair (two signs) to the merged token (one sign) is at the same
time its rank, as ids are ranks. The map is a literal: an array of small maps, found by the pair's crc32, since a lookup in one
large map would go through all keys; pairs of bytes, with which every word begins, are a plain array.

Texts are cut into words by Spark's regular expressions and taken in blocks of about ``BLOCK`` words, stretches of rows of an input partition.
A block sends its distinct words once; all blocks' words meet by word, where each distinct word is folded once; its tokens go back to the
blocks that hold it, packed with those of the block's other words in the same partition, and meet the block's texts as numbers of words, not as texts. A word's rows are as many as the blocks that hold it; no
vocabulary is gathered anywhere.

``docs`` is read twice and must give the same rows in the same partitions both times, as files and tables do; a block that
differs raises an error. A null text counts as empty and has no ids. Repeated rows give repeated rows, an empty table an empty one; only ``doc_id``
and ``text`` are read, so further columns do not matter. A text of more than ``BLOCK`` words is a block of its own. A word of more
than ``CHUNK`` bytes is folded chunk by chunk, see ``fold_long``.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 5_000_000  # words of a block
HELD = 500_000  # words whose tokens are packed together
STEP = 500_000  # words that are turned into ids at once
CHUNK, BACK = 64, 8  # bytes of a chunk of a long word; tokens before it that are looked at again
PAIRS = 1 << 15  # buckets of the rank map
SURROGATES, GAP = 0xD800, 0x800
NONE = "\U0010ffff"  # no token: greater than every sign
ALL = 1 << 30


def sign(token: int) -> str:
    """The character that stands for an id; the order of ids is kept."""
    return chr(token if token < SURROGATES else token + GAP)


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def halves(token: bytes, known: dict[bytes, int]) -> list[bytes]:
    """The parts of a token before its last merge; a token that merges cannot build stays in more than two."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, i = min((known.get(parts[i] + parts[i + 1], known[token]), i) for i in range(len(parts) - 1))
        if least >= known[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def literal(value: list, kind: str) -> Column:
    """A value that becomes one literal when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), kind)


def literal_map(entries: Iterable[tuple[str, str]], buckets: int) -> Column:
    """A map from strings to strings as an array of small maps for ``find``: an entry lies in the bucket of its key's crc32."""
    out: list[dict[str, str]] = [{} for _ in range(buckets)]
    for key, value in entries:
        out[zlib.crc32(key.encode()) % buckets][key] = value
    return literal(out, "array<map<string,string>>")


def find(table: Column, buckets: int, key: Column) -> Column:
    """The value of a key, null if there is none; only the key's bucket is read."""
    return F.get(table, (F.crc32(key.cast("binary")) % buckets).cast("int"))[key]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


class Codec:
    """What a rank file says: merges of pairs (a literal), signs of single bytes (a literal), bytes of tokens (each byte one character; a literal)."""

    def __init__(self, path: str):
        known = ranks(path)
        # a token that merges cannot build has no pair: no text ever holds it
        parts = [(halves(token, known), rank) for token, rank in known.items() if len(token) > 1]
        by_rank = {rank: token.decode("latin-1") for token, rank in known.items()}
        self.pairs = literal_map(((sign(known[p[0]]) + sign(known[p[1]]), sign(rank)) for p, rank in parts if len(p) == 2), PAIRS)
        self.single = literal([sign(known[bytes([i])]) for i in range(256)], "array<string>")
        self.double = literal([sign(known[pair]) if (pair := bytes([i >> 8, i & 255])) in known else NONE for i in range(1 << 16)], "array<string>")
        self.texts = [by_rank.get(i, "") for i in range(max(by_rank) + 1)]
        self.pieces = literal(self.texts, "array<string>")

    def literals(self) -> Column:
        return F.struct(self.pairs.alias("pairs"), self.single.alias("single"), self.double.alias("double"), self.pieces.alias("pieces"))


def rank(at: Column, pair: Column) -> Column:
    return F.coalesce(find(at["pairs"], PAIRS, pair), F.lit(NONE))


def fold(at: Column, raw: Column) -> Column:
    """Signs of a word given as one character a byte: the pair of least rank, leftmost first, is merged until no pair has one.

    The state is the tokens (``p``) and the ranks of neighbours (``r``), both as signs; a merge looks up its two new pairs only.
    """
    def step(s: Column, _: Column) -> Column:
        p, r = s["p"], s["r"]

        def merge(m: Column) -> Callable[[Column], Column]:
            return lambda k: F.struct(
                F.concat(F.substring(p, F.lit(1), k - 1), m, F.substring(p, k + 2, F.lit(ALL))).alias("p"),
                F.concat(
                    F.substring(r, F.lit(1), k - 2),
                    F.when(k > 1, rank(at, F.concat(F.substring(p, k - 1, F.lit(1)), m))).otherwise(""),
                    F.when(k < F.length(r), rank(at, F.concat(m, F.substring(p, k + 2, F.lit(1))))).otherwise(""),
                    F.substring(r, k + 2, F.lit(ALL)),
                ).alias("r"))

        least = F.coalesce(F.nullif(F.array_min(F.split(r, "")), F.lit("")), F.lit(NONE))
        return let(least, lambda m: F.when(m < NONE, let(F.call_function("locate", m, r), merge(m))).otherwise(s))

    def start(codes: Column) -> Column:
        p = F.array_join(F.transform(codes, lambda c: F.get(at["single"], c)), "")
        r = F.array_join(F.transform(F.slice(codes, 2, F.lit(ALL)), lambda c, i: F.get(at["double"], 256 * F.get(codes, i) + c)), "")
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(raw), F.lit(2))), F.struct(p.alias("p"), r.alias("r")), step, lambda s: s["p"])

    return let(F.transform(F.split(raw, ""), lambda c: F.ascii(c)), start)


def fold_long(at: Column, raw: Column, pieces: Column) -> Column:
    """``fold`` of a long word in chunks, with the same result.

    A sequence of tokens is the one that merging gives if every two neighbours are what merging gives for their joint bytes. The
    last ``BACK`` tokens are folded again together with the next chunk; if the first of them comes out as before, all neighbours
    were seen together. If not, everything so far is folded as a whole.
    """
    def width(signs: Column) -> Column:
        return F.aggregate(F.split(signs, ""), F.lit(0), lambda n, c: n + F.length(F.get(pieces, F.ascii(c))))

    def chunk(q: Column, i: Column) -> Column:
        def again(tail: Column) -> Column:
            start = i - width(tail)
            return let(fold(at, F.substring(raw, start, i + CHUNK - start)), lambda u: F.when(
                (F.substring(u, F.lit(1), F.lit(1)) == F.substring(tail, F.lit(1), F.lit(1))) | (F.length(q) <= BACK),
                F.concat(F.substring(q, F.lit(1), F.greatest(F.length(q) - BACK, F.lit(0))), u),
            ).otherwise(fold(at, F.substring(raw, F.lit(1), i + CHUNK - 1))))

        return let(F.substring(q, F.lit(-BACK), F.lit(BACK)), again)

    return F.aggregate(F.sequence(F.lit(1 + CHUNK), F.length(raw), F.lit(CHUNK)), fold(at, F.substring(raw, F.lit(1), F.lit(CHUNK))), chunk)


def word_signs(at: Column, word: Column) -> Column:
    """Signs of a word; ``at`` has the fields ``pairs``, ``single`` and ``pieces`` of a codec."""
    return let(F.decode(word.cast("binary"), "ISO-8859-1"), lambda raw: F.when(F.length(raw) <= CHUNK, fold(at, raw)).otherwise(fold_long(at, raw, at["pieces"])))


@lru_cache(maxsize=None)
def members(kind: str) -> str:
    """All characters of a class (``\\p{L}``, ``\\p{N}``, ``\\s``) as the tiktoken library sees them."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    library = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(library.encode_ordinary(every)).decode()


def spans(characters: str) -> str:
    """Characters as ranges of a Java character class."""
    out, points = [], [ord(c) for c in characters]
    for point in points:
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for Java: white space by Unicode, and the letters and numbers that the JVM's older tables do not know.

    Those are few and rare; a character below the first of them is not compared with them.
    """
    classes = {"\\s": "\\p{IsWhite_Space}"}
    for kind in ("\\p{L}", "\\p{N}"):
        rest = spark.range(1).select(F.regexp_replace(F.lit(members(kind)), kind, "")).first()[0]
        classes[kind] = kind + (f"[\\x{{{ord(min(rest)):X}}}-\\x{{10FFFF}}&&[{spans(rest)}]]" if rest else "")
    known = r"\\p\{[LN]\}|\\s"

    def inside(match: re.Match) -> str:
        return re.sub(known, lambda m: classes[m[0]], match[0])

    def outside(match: re.Match) -> str:
        found = match[0]
        return inside(match) if found[0] == "[" else "\\P{IsWhite_Space}" if found == "\\S" else f"[{classes[found]}]"

    return re.sub(rf"\[[^\]]*\]|{known}|\\S", outside, pattern)


def words(text: Column, pattern: str) -> Column:
    """All matches of the pattern in a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def in_blocks(docs: DataFrame, pattern: str, schema: str, each: Callable, block: int) -> DataFrame:
    """``each(number, doc_ids, word counts, distinct words in order, their numbers, the numbers in the texts)`` of every block of ``block`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = [i for part in held for i in part.column(0).to_pylist()]
            counts = np.concatenate([pc.list_value_length(part.column(1)).to_numpy() for part in held])
            # an empty array first, as a block may hold no word
            none = pa.array([], held[0].column(1).type.value_type)
            coded = pa.chunked_array([none, *(part.column(1).flatten() for part in held)]).dictionary_encode().unify_dictionaries()
            codes = np.concatenate([np.zeros(0, np.int32), *(part.indices.to_numpy() for part in coded.chunks)])
            known = coded.chunk(0).dictionary if coded.num_chunks else none
            order = pc.sort_indices(known).to_numpy()
            # a word's number is its place by frequency: most numbers are small
            place = np.empty(len(order), np.int32)
            place[order[np.argsort(-np.bincount(codes, minlength=len(order))[order], kind="stable")]] = np.arange(len(order), dtype=np.int32)
            yield from each(number, ids, counts, known.take(pa.array(order)), place[order], place[codes])

        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = upto[start - 1] if start else 0
                fit = int(np.searchsorted(upto, before + block - n, "right"))
                if fit <= start and n:  # no row fits beside those held
                    yield from flush()
                    number, held, n = number + 1, [], 0
                    continue
                stop = max(fit, start + 1)
                held.append(batch.slice(start, stop - start))
                n += int(upto[stop - 1] - before)
                start = stop
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), words(F.col("text"), pattern).alias("words")).mapInArrow(run, schema)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, the bytes of one place of all numbers together, as they compress better so."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.Codec("zstd", 6).compress(planes, asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed``."""
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def words_of_block(number: int, ids: list, counts: np.ndarray, known: pa.Array, place: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's distinct words."""
    for i in range(0, len(known), 50_000):
        some = known[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(some), number)), "code": pa.array(place[i : i + 50_000], pa.int32()), "word": some})


def texts_of_block(number: int, ids: list, counts: np.ndarray, known: pa.Array, place: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's texts as numbers of words."""
    yield pa.RecordBatch.from_pydict({
        "block": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts.tolist()], pa.list_(pa.int32())),
        "codes": pa.array([packed(codes)], pa.binary()), "known": pa.array([len(known)], pa.int64())})


def tokens_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' signs ``block, code, signs`` as one row a block, in stretches of about ``HELD`` words: steps between the words' numbers, their
    lengths in tokens and their ids, packed."""
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        block, code = table["block"].to_numpy(), table["code"].to_numpy()
        order = np.lexsort((code, block))
        block, code, signs = block[order], code[order], table["signs"].take(pa.array(order))
        length = pc.utf8_length(signs).to_numpy().astype(np.int64)
        flat = np.frombuffer("".join(signs.to_pylist()).encode("utf-32-le"), "<u4")
        flat = flat - np.where(flat >= SURROGATES, GAP, 0)
        upto = np.concatenate([[0], np.cumsum(length)])
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        rows = [(int(block[a]), b - a, int(upto[b] - upto[a]), packed(np.diff(code[a:b], prepend=0)), packed(length[a:b]), packed(flat[upto[a] : upto[b]]))
                for a, b in zip(cuts, cuts[1:])]
        kinds = {"of": pa.int64(), "words": pa.int64(), "tokens": pa.int64(), "codes": pa.binary(), "lengths": pa.binary(), "flat": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], names=list(kinds))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that the chosen entries name, one behind the other."""
    size = length[chosen]
    ends = np.cumsum(size)
    return flat[np.repeat(start[chosen] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces:
    """Joins the pieces of packed ids."""

    def __init__(self, texts: list[str]):
        pieces = [t.encode("latin-1") for t in texts]
        self.flat, self.length = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(spread(self.flat, self.start, self.length, ids[i : i + STEP]).tobytes() for i in range(0, len(ids), STEP))


def encode(docs: DataFrame, codec: Codec, pattern: str, block: int = BLOCK, decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, packed as little-endian unsigned 32-bit numbers; ``decoded`` adds ``bytes``, what the ids decode to."""
    java = java_pattern(docs.sparkSession, pattern)
    by_word = in_blocks(docs, java, "block long, code int, word string", words_of_block, block).repartition("word")
    first = F.row_number().over(Window.partitionBy("word").orderBy("block")) == 1
    folded = by_word.withColumn("_first", first).withColumn("_once", F.when(F.col("_first"), let(codec.literals(), lambda at: word_signs(at, F.col("word")))))
    tokens = folded.select("block", "code", F.max("_once").over(Window.partitionBy("word")).alias("signs"))
    tokens = tokens.mapInArrow(tokens_of_blocks, "of long, words long, tokens long, codes binary, lengths binary, flat binary")
    texts = in_blocks(docs, java, "block long, ids array<long>, counts array<int>, codes binary, known long", texts_of_block, block)

    pieces = Pieces(codec.texts) if decoded else None

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) != 1 or left["known"][0].as_py() != (pc.sum(right["words"]).as_py() or 0):
            raise RuntimeError("the documents gave other rows when they were read again; write them to a table first")
        parts = right.to_pylist()
        none = np.zeros(0, "<u4")
        order = np.argsort(np.concatenate([none, *(np.cumsum(unpacked(p["codes"], p["words"]), dtype=np.int64) for p in parts)]))
        length = np.concatenate([none, *(unpacked(p["lengths"], p["words"]) for p in parts)]).astype(np.int64)
        flat = np.concatenate([none, *(unpacked(p["flat"], p["tokens"]) for p in parts)]).astype("<u4")
        start = (np.cumsum(length) - length)[order]
        length = length[order]
        codes = unpacked(left["codes"][0].as_py(), sum(left["counts"][0].as_py()))
        upto = np.concatenate([[0], np.cumsum(left["counts"][0].as_py())])
        out, i = [], 0
        while i < len(upto) - 1:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + STEP, "right")) - 1)
            chosen = codes[upto[i] : upto[j]]
            raw = spread(flat, start, length, chosen).tobytes()
            ends = 4 * np.concatenate([[0], np.cumsum(length[chosen])])[upto[i : j + 1] - upto[i]]
            out += [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
            i = j
        columns = {"doc_id": pa.array(left["ids"][0].as_py(), pa.int64()), "ids": pa.array(out, pa.binary())}
        return pa.table(columns | ({"bytes": pa.array([pieces.join(x) for x in out], pa.binary())} if pieces else {}))

    return texts.groupBy("block").cogroup(tokens.groupBy("of")).applyInArrow(joined, "doc_id long, ids binary" + (", bytes binary" if decoded else ""))


def ids(packed: Column) -> Column:
    """Packed ids as an array of long."""
    byte = lambda i, k: F.conv(F.hex(F.substring(packed, 4 * i + k + 1, F.lit(1))), 16, 10).cast("long")
    numbers = F.sequence(F.lit(0), F.greatest((F.octet_length(packed) / 4).cast("int") - 1, F.lit(0)))
    each = F.transform(numbers, lambda i: byte(i, 0) + 256 * byte(i, 1) + 65536 * byte(i, 2) + 16777216 * byte(i, 3))
    return F.when(F.octet_length(packed) > 0, each).otherwise(F.array().cast("array<bigint>"))


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """Add ``bytes``: the pieces of a text's tokens joined."""
    pieces = Pieces(codec.texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                texts = pa.array([pieces.join(x) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
